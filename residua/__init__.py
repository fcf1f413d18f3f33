"""Protein-sequence analytics and training-data operators on Spark."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: What the package offers by name; loaded when asked for, so that Python workers start light.
_EXPORTS = {
    "read_fasta": "residua.sources.fasta",
    "read_headers": "residua.sources.fasta",
    "read_hits": "residua.sources.hits",
    "load_model": "residua.operators.model",
    "predict": "residua.operators.model",
    "save_model": "residua.operators.model",
    "train_classifier": "residua.operators.model",
}
__all__ = ["__version__", *_EXPORTS]


def __getattr__(name: str):
    if name not in _EXPORTS:
        raise AttributeError(name)
    return getattr(importlib.import_module(_EXPORTS[name]), name)
