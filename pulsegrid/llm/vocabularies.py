"""Where the vocabulary files of public tokenizers lie."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    """The path of a file of the installed package of vocabularies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
