"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and their SQL oracles."""

from __future__ import annotations

from . import chain, cleaning, collection, corpus, evaluation, extras, packing  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL  # noqa: F401
