"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as the ends of a text may have it.
BLANKS = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col(c), BLANKS, "")


def tokens(c) -> Column:
    """Lower-case runs of letters, digits and low lines."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def canonical_route(c) -> Column:
    """Without slashes at the end, but the root itself stays."""
    return F.when(col(c).rlike("^/+$"), "/").otherwise(F.regexp_replace(col(c), "/+$", ""))


def anchor_of(key) -> Column:
    return F.split_part(col(key), F.lit("#"), F.lit(1))


def heading_of(key, title) -> Column:
    """What follows the first number sign of a key; the title where nothing does."""
    rest = F.regexp_extract(col(key), r"(?s)^[^#]*#(.*)$", 1)
    return F.when(rest == "", col(title)).otherwise(rest)


def section_url(route, key) -> Column:
    page, anchor = canonical_route(route), anchor_of(key)
    return F.when(anchor == "", page).otherwise(F.concat(page, F.lit("#"), anchor))


def emptiness(key, text) -> Column:
    """`non-empty`, `legitimate` (a page's own or a numbered heading's) or `suspicious`."""
    numbered = anchor_of(key).rlike("^heading-[0-9]+$")
    own = (col(key) == "") | col(key).startswith("#")
    return F.when(F.coalesce(stripped(text), F.lit("")) != "", "non-empty").when(own | numbered, "legitimate").otherwise("suspicious")


def source_of(route) -> Column:
    return F.when(col(route).startswith("/treadmill/"), "treadmill").otherwise("blog")


def sentences(c) -> Column:
    """Whole sentences with the blanks that follow them; joined they give the text again."""
    return F.regexp_extract_all(col(c), F.lit(r"(?s)(.+?(?:[.!?](?:\s+|\z)|\z))"), F.lit(1))


def pieces_and_gaps(c) -> Column:
    """Words and the white space between them, in order and without loss."""
    return F.regexp_extract_all(col(c), F.lit(r"(\S+|\s+)"), F.lit(1))


def keyword_units(c) -> Column:
    """Single ideographs, else runs of letters of the listed scripts."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]|[0-9a-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}]+)"), F.lit(1))


def model_slug(c) -> Column:
    """Lower case, low lines and blanks as hyphens, other signs dropped, hyphens single."""
    slug = F.regexp_replace(F.lower(F.trim(col(c))), r"[_\s]+", "-")
    return F.regexp_replace(F.regexp_replace(slug, r"[^a-z0-9.\-]", ""), "-+", "-")


def without_remark(c) -> Column:
    return F.regexp_replace(col(c), r"\s*\([^)]*\)\s*$", "")


def choice_letter(c) -> Column:
    """The first of A to D that stands by itself at its right, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"([ABCD])(?=[^A-Za-z0-9_]|$)", 1), F.lit(""))


def collapsed(c) -> Column:
    return F.regexp_replace(col(c), r"\s+", " ")


def highlighted(c, word: str) -> Column:
    """Every occurrence of a literal, whatever its case, between marks."""
    return F.regexp_replace(col(c), "(?i)(" + "".join("\\" + x if not x.isalnum() else x for x in word) + ")", "<mark>$1</mark>")


def headlines(c) -> Column:
    """Second and third level headings with their signs, in order."""
    return F.regexp_extract_all(col(c), F.lit(r"(?m)^(#{2,3}[ \t]+[^\n]*)$"), F.lit(1))


def first_title(c) -> Column:
    """A first-level heading at the very start of the text, null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"^# ([^\n]*)", 1), F.lit(""))


def bert_clean(c) -> Column:
    """Control and format signs dropped, blanks unified, ideographs set apart."""
    kept = F.regexp_replace(col(c), r"[\x{0}\x{fffd}]|[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    spaced = F.regexp_replace(kept, r"([\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}])", " $1 ")
    return F.trim(F.regexp_replace(spaced, r"[\s\p{Z}]+", " "))


def basic_units(c) -> Column:
    """Runs without blanks and punctuation, and each punctuation sign by itself."""
    return F.regexp_extract_all(F.lower(bert_clean(c)), F.lit(r"([\p{P}\p{S}]|[^\s\p{P}\p{S}]+)"), F.lit(1))


def bibtex(key: Column, fields: dict[str, Column]) -> Column:
    """An entry for a page with its fields in order."""
    lines = [F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")) for name, value in fields.items()]
    return F.concat(F.lit("@misc{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))
