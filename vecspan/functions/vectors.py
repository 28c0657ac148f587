"""Vector functions on ARRAY columns, computed in DOUBLE inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def magnitude(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def _divided(v: Column, by: Column) -> Column:
    """v / by, where by is worked out once and not anew for every element."""
    return F.get(F.transform(F.array(by), lambda n: F.transform(v, lambda x: x / n)), 0)


def l2_normalise(v: Column) -> Column:
    """v / |v|; null for the zero vector."""
    return _divided(v, F.nullif(magnitude(v), F.lit(0.0)))


def length_normalise(v: Column) -> Column:
    """v scaled to length sqrt(dimension)."""
    return _divided(v, F.nullif(magnitude(v), F.lit(0.0)) / F.sqrt(F.size(v).cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; null if either vector is zero."""
    return dot(a, b) / F.nullif(magnitude(a) * magnitude(b), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]."""
    return (cosine(a, b) + 1) / 2


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in rows])


def project(v: Column, columns: list[list[float]]) -> Column:
    """(v . column) for every column of a matrix given by its columns."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in c])) for c in columns])


def affine(v: Column, mean: list[float], columns: list[list[float]]) -> Column:
    """(v - mean) times a matrix given by its columns."""
    return project(subtract(v, F.array(*[F.lit(float(x)) for x in mean])), columns)


def plda_llr(enrol: Column, test: Column, psi: Column, n: Column) -> Column:
    """Log-likelihood ratio of two transformed vectors: psi has the between-class variances, n the enrolment count."""
    cols = F.arrays_zip(enrol.alias("u"), test.alias("v"), psi.alias("p"))

    def term(z: Column) -> Column:
        scale = n * z["p"] / (n * z["p"] + 1)
        var = 1 + z["p"] / (n * z["p"] + 1)
        given = -0.5 * (F.log(var) + (z["v"] - scale * z["u"]) * (z["v"] - scale * z["u"]) / var)
        without = -0.5 * (F.log(1 + z["p"]) + z["v"] * z["v"] / (1 + z["p"]))
        return given - without

    return F.aggregate(F.transform(cols, term), F.lit(0.0), lambda s, x: s + x)


def angle(a: Column, b: Column) -> Column:
    """Angular separation in radians."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def azimuth(x: Column, y: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def circular_distance(a: Column, b: Column) -> Column:
    """Shorter way between two angles of degrees."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def wrap_degrees(a: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def cyclic_resize(v: Column, n: int | Column) -> Column:
    """The first n elements of v repeated without end."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(v, (i % F.size(v)).cast("int")))


def hashed_unit(*key: Column) -> Column:
    """A number in [0, 1) from md5 of the key's parts joined by ':'; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 4294967296.0


def chunk(v: Column, n: int, *key: Column) -> Column:
    """n neighbouring elements from a hashed start; shorter arrays are repeated to n."""
    start = F.floor(hashed_unit(*key) * (F.size(v) - n + 1)).cast("int")
    return F.when(F.size(v) >= n, F.slice(v, F.greatest(start, F.lit(0)) + 1, n)).otherwise(cyclic_resize(v, n))


def crops(v: Column, n: int, count: int, *key: Column) -> Column:
    """count chunks of n elements."""
    return F.array(*[chunk(v, n, *key, F.lit(k)) for k in range(count)])


def mel(hz: Column) -> Column:
    return 2595.0 * F.log10(1 + hz / 700.0)


def mel_natural(hz: Column) -> Column:
    return 1127.0 * F.log(1 + hz / 700.0)


def hz_of_mel(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def margin_logits(cos: Column, target: Column, kind: str, margin: float, scale: float) -> Column:
    """Scaled logits with an additive (am), angular (aam) or multiplicative (sphere) margin on the target."""
    sin = F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos))
    if kind == "am":
        with_margin = cos - margin
    elif kind == "aam":
        plain = cos * math.cos(margin) - sin * math.sin(margin)
        with_margin = F.when(cos > math.cos(math.pi - margin), plain).otherwise(cos - math.sin(math.pi - margin) * margin)
    elif kind == "sphere":
        theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))
        k = F.floor(margin * theta / math.pi)
        with_margin = F.pow(F.lit(-1.0), k) * F.cos(margin * theta) - 2 * k
    else:
        raise ValueError(f"unknown margin {kind}")
    return scale * F.when(target, with_margin).otherwise(cos)


def top_features(v: Column, k: int) -> Column:
    """The k largest elements, in descending order."""
    return F.slice(F.sort_array(v, asc=False), 1, k)
