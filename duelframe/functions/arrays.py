"""Array expressions that evaluate what they use often only once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(v: Column, f: Callable[[Column], Column]) -> Column:
    """f(v), where f may use its argument often: v is evaluated once."""
    return F.element_at(F.transform(F.array(v), f), 1)


def l2_normalised(v: Column, eps: float = 1e-12) -> Column:
    def scaled(x: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y.cast("double") * y)), F.lit(eps))
        return once(norm, lambda n: F.transform(x, lambda y: y.cast("double") / n))

    return once(v, scaled)


def softmax(v: Column) -> Column:
    def scaled(e: Column) -> Column:
        return once(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda t: F.transform(e, lambda x: x / t))

    return once(once(v, lambda w: once(F.array_max(w), lambda top: F.transform(w, lambda x: F.exp(x - top)))), scaled)
