"""Vector and score functions as Columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector of `v`; the norm counts as 1e-12 at least."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    # As an argument of zip_with the norm is taken once a vector; inside a lambda it would be once an element.
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n)


def fingerprint(model: str, dim: int, chunk_id: Column, text: Column) -> Column:
    """SHA-256 that changes with the model, its dimension, the id or the text of a row."""
    return F.sha2(F.concat_ws("\x1f", F.lit(f"{model}:{dim}"), chunk_id.cast("string"), text).cast("binary"), 256)


def cards_for(chars: Column) -> Column:
    """Number of cards that a passage of so many characters gives."""
    per = F.floor(chars / rules.DECK_CHARS_PER_CARD).cast("int")
    return F.greatest(F.lit(rules.DECK_MIN_CARDS), F.least(F.lit(rules.DECK_MAX_CARDS), per))
