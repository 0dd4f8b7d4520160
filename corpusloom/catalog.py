"""The registered queries of the corpus and tokenizer operators, and SQL for them."""

from __future__ import annotations

from .plans.corpus import QUERIES
from .plans.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
