"""Column expressions over harvested model records: release names and stated numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the unit letters and words that follow a stated count.
UNITS = {"k": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12}

SEPARATORS = r"[\s\p{Z}_:/\\|,­​‐-―−﹘﹣－-]+"
#: Name, version, size and an optional variant word at the end of a cleaned model name.
NAME = r"^(?:.* )?(\p{L}+) ?v?(\d+(?:\.\d+)*) (\d+(?:\.\d*[1-9])?)(?:\.0+|0+)? ?([kmbt])(?: (\p{L}+))?$"
STATED = r"^[~≈≃∼≅<>=≤≥]*(?:ca\.?|about|approx\.?|circa)?\s*\+?((?:\d{1,3}(?:[,_' ]\d{3})+|\d+)(?:\.\d+)?(?:e\+?\d+)?)\s*(k|mn|million|m|bn|billion|b|tn|trillion|t)?\s*\+?\s*(?:params?|parameters?)?\s*(?:\([^()]*\))?$"


def clean_name(model: Column) -> Column:
    """Lower case, without a last remark in parentheses, separators as single blanks."""
    bare = F.regexp_replace(F.lower(model), r"\s*\([^()]*\)[\s\p{Z}]*$", "")
    return F.trim(F.regexp_replace(bare, SEPARATORS, " "))


def once(value: Column, use) -> Column:
    """`use` of a value that is worked out a single time, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def release_key(model: Column, creator: Column) -> Column:
    """What names a release: name, version, size and variant word.

    Case, separators, a creator put in front and a last remark in parentheses don't
    matter. A name that has no version and size is itself the key, without the row's own
    creator in front; null and blank names give null.
    """

    def key(name: Column) -> Column:
        told = F.regexp_replace(name, NAME, "$1|$2|$3$4|$5")
        front = F.concat(clean_name(creator), F.lit(" "))
        rest = F.when(name.startswith(front), F.substring(name, F.length(front) + 1, F.length(name))).otherwise(name)
        return once(told, lambda k: F.when(k.contains("|"), k).otherwise(F.nullif(rest, F.lit(""))))

    return once(clean_name(model), key)


def stated_count(text: Column) -> Column:
    """A count in any notation ("7B", "~7.2 b (est.)", "405,000M", "0.07T", "7200000000")
    as a double; null where none above zero is stated."""
    bare = F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))

    def count(told: Column) -> Column:
        number = F.regexp_replace(F.split_part(told, F.lit("\x01"), F.lit(1)), r"[,_' ]", "").try_cast("double")
        unit = F.nullif(F.split_part(told, F.lit("\x01"), F.lit(2)), F.lit(""))
        factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), unit), F.lit(1.0))
        return F.when(told.contains("\x01") & (number > 0), number * factor)

    return once(F.regexp_replace(bare, STATED, "$1\x01$2"), count)


def positive(value: Column) -> Column:
    """A usable measurement: a finite number above zero, else null."""
    x = value.cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def share(value: Column) -> Column:
    """A usable share, percentages brought to 0..1."""
    x = positive(value)
    return F.when(x > 1, x / 100).otherwise(x)
