"""Plans: operators bound to the given tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module once, which fills the registry."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
