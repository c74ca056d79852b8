"""Numeric and vector expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_nan(c) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def dot(a, b) -> Column:
    """Inner product with a double accumulator."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def valid_vector(v) -> Column:
    """Finite in every place and not zero everywhere."""
    finite = F.forall(col(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.size(col(v)).__gt__(0) & finite & F.exists(col(v), lambda x: x != 0)


def row_scale(v) -> Column:
    """Largest magnitude over 127, 1 for a zero vector."""
    top = F.array_max(F.transform(col(v), lambda x: F.abs(x.cast("double"))))
    return F.when(top > 0, top / 127.0).otherwise(1.0)


def quantized(v, scale) -> Column:
    """Signed bytes: rounded half to even, clipped to 127."""
    return F.transform(col(v), lambda x: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(x.cast("double") / col(scale)))).cast("int"))


def dequantized(q, scale) -> Column:
    return F.transform(col(q), lambda x: x * col(scale))


def reciprocal_rank(keyword, semantic, k: int = 60, keyword_weight: float = 1.0, semantic_weight: float = 2.0) -> Column:
    """Weighted reciprocal rank fusion; a missing rank adds nothing."""
    return F.coalesce(keyword_weight / (k + col(keyword)), F.lit(0.0)) + F.coalesce(semantic_weight / (k + col(semantic)), F.lit(0.0))


def parsed_suffix(c) -> Column:
    """"70B" as 7e10; T, B and M count, anything else is null."""
    number = F.regexp_extract(F.trim(col(c)), r"^([0-9]+(?:\.[0-9]+)?)\s*[TBMtbm]$", 1).try_cast("double")
    unit = F.upper(F.right(F.trim(col(c)), F.lit(1)))
    return number * F.when(unit == "T", 1e12).when(unit == "B", 1e9).when(unit == "M", 1e6)


def formatted_suffix(c) -> Column:
    """The reverse: two decimals where the scaled number isn't whole."""
    x = col(c)
    scaled = F.when(x >= 1e12, x / 1e12).when(x >= 1e9, x / 1e9).otherwise(x / 1e6)
    unit = F.when(x >= 1e12, "T").when(x >= 1e9, "B").otherwise("M")
    return F.concat(F.when(scaled == F.floor(scaled), F.floor(scaled).cast("string")).otherwise(F.format_string("%.2f", scaled)), unit)


def ceil_to(c, places: int) -> Column:
    return F.ceil(col(c) * 10**places) / 10**places


def blended_price(inputs, outputs) -> Column:
    """Three parts of input price to one of output."""
    return (3 * col(inputs) + col(outputs)) / 4


def luminance(hexed) -> Column:
    """Relative luminance of a #rrggbb colour."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(col(hexed), at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a, b) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
