"""Vector scores as columns, summed in double in element order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null for different lengths, a zero norm or elements that are not finite."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    c = dot(a, b) / n
    ok = (F.size(a) == F.size(b)) & (n > 0) & ~F.isnan(n) & (n < float("inf"))
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def contrastive(image: Column, positive: Column, negative: Column) -> Column:
    """Half the difference of the similarities, null if one of them is; without a negative the plain similarity."""
    p, n = cosine(image, positive), cosine(image, negative)
    return F.when(negative.isNull(), p).when(p.isNotNull() & n.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p - n) / 2)))
