import re
from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from helpers import docs, given, long_text
from hypothesis import given as forall
from hypothesis import settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pulsegrid.llm.prefix_counts import _byte_chars
from pulsegrid.llm.token_alignment import alignments, parts, terminals
from pulsegrid.llm.vocabularies import vocabulary

FIRST, SECOND = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


class Plain:
    """The contract with loops over bytes, by the libraries that the files belong to."""

    def __init__(self):
        self.a = Tokenizer.from_file(FIRST)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=SECOND)
        self.chars = _byte_chars()

    def tokens(self, text):
        if not text:
            return None
        want = b" " + text.encode()
        a = [(i, bytes(self.chars[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
            b.append((i, bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()))
        if b"".join(t for _, t in a) != want or b"".join(t for _, t in b) != want:
            return None
        return [self.spans(x) for x in (a, b)]

    @staticmethod
    def spans(tokens):
        at, out = 0, []
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def table(self, texts):
        all_links, made = Counter(), []
        for text in texts:
            both = self.tokens(text)
            if both is None:
                made.append(None)
                continue
            a, b = both
            owner = {byte: j for j, (_, lo, hi) in enumerate(b) for byte in range(lo, hi)}
            links = [(i, b[j][0]) for i, lo, hi in a for j in sorted({owner[x] for x in range(lo, hi)})]
            all_links.update(links)
            cuts = sorted({hi for *_, hi in a} & {hi for *_, hi in b})
            sides = [[[] for _ in cuts] for _ in both]
            for side, tokens in zip(sides, both, strict=True):
                for i, _, hi in tokens:
                    side[bisect_left(cuts, hi)].append(str(i))
            groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides, strict=True)]
            made.append((len(a), len(b), links, groups))
        most = Counter()
        for (_, b), n in all_links.items():
            most[b] = max(most[b], n)
        out = []
        for one in made:
            if one is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            n_a, n_b, links, groups = one
            best = sum(all_links[x] == most[x[1]] for x in links)
            total = sum(all_links[x] for x in links)
            out.append((n_a, n_b, len(groups), len(links), best, total, sha256(";".join(groups).encode()).hexdigest()))
        return out


def rows_of(frame):
    return sorted(
        ((r["doc_id"], (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])) for r in frame.collect()), key=str
    )


@pytest.mark.parametrize("frequent", [2_000_000, 300, 0])
def test_equal_to_loops_over_the_given_documents(spark, frequent):
    rows = given("documents", "doc_id, text")
    want = sorted(zip([d for d, _ in rows], Plain().table([t for _, t in rows]), strict=True), key=str)
    got = rows_of(alignments(spark, spark.createDataFrame(rows, "doc_id long, text string"), FIRST, SECOND, frequent))
    assert got == want


def test_edge_rows(spark):
    texts = [None, "", " ", "a", "a", "<|endoftext|></s><s>", "a▁b", "\x00\t\n", "日本語のテキスト 🙂🙂", "  two  spaces ", "don't " * 50, long_text(3000), "x" * 5000, None]
    ids = [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10, 11, 12, None]
    want = sorted(zip(ids, Plain().table(texts), strict=True), key=str)
    assert rows_of(alignments(spark, docs(spark, texts, ids=ids), FIRST, SECOND)) == want
    assert [w for d, w in want if d == 6] == [(0, 0, 0, 0, 0, 0, "")]
    assert alignments(spark, docs(spark, []), FIRST, SECOND).count() == 0


def test_a_very_long_text_is_the_sum_of_its_parts(spark):
    text = long_text(120_000)
    cut = list(parts(text))
    assert len(cut) > 2 and " ".join(cut) == text
    got = rows_of(alignments(spark, docs(spark, [text]), FIRST, SECOND))
    assert got == [(0, Plain().table([text])[0])]


@settings(max_examples=60, deadline=None)
@forall(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_terminals_label_the_stretches_between_common_ends(a, b):
    ends = [np.array(sorted(x | {61})) for x in (a, b)]
    starts = [np.concatenate([[0], e[:-1]]) for e in ends]
    common = np.array(sorted((a & b) | {61}))
    last_a, last_b = terminals(starts[0], ends[0], starts[1], ends[1])
    for own, last in zip(ends, (last_a, last_b), strict=True):
        assert (ends[1][last] == common[np.searchsorted(common, own)]).all()
