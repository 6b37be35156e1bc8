"""Column functions over titles and page bodies.

Patterns are Java regular expressions with (?idU): letters, digits and spaces in the Unicode sense, case
folded in that sense too, and only \\n as a line end. A pattern that does not match gives null, never ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, fold: bool = True) -> str:
    return ("(?idU)" if fold else "(?dU)") + pattern


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, stripped; null without a match."""
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, group)))


def all_found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def contains_any(c: Column, words) -> Column:
    """Whether a (lower-cased) column has one of words anywhere, also inside longer words; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words)), F.lit(False))


# Title endings.
_STALE_WORDS = "old|deprecated|archived|legacy|obsolete|copy|draft|backup"
_STALE_END = rx(rf"\s*\(\s*(?:{_STALE_WORDS})\s*\)\s*$")
_YEAR_END = rx(r"\s+(?:19|20)\d{2}\s*$")
_VERSION_END = rx(r"\s+(?:v|version\s*)\d+(?:\.\d+)*\s*$")


def title_parts(title: Column) -> Column:
    """struct(base, version, stale): the lower-cased title without its endings, its year or version, its stale mark.

    A year is an ending only behind at least two words or behind a version; it then wins over the version."""
    whole = strip(title)
    rest = strip(F.regexp_replace(whole, _STALE_END, ""))
    before = strip(F.regexp_replace(rest, _YEAR_END, ""))
    dated = rest.rlike(_YEAR_END) & (before.rlike(r"(?U)\S\s+\S") | before.rlike(_VERSION_END))
    base = F.lower(strip(F.regexp_replace(F.when(dated, before).otherwise(rest), _VERSION_END, "")))
    version = F.when(dated, found(rest, _YEAR_END, 0)).otherwise(found(rest, _VERSION_END, 0))
    return F.struct(base.alias("base"), version.alias("version"), found(whole, _STALE_END, 0).alias("stale"))


def base_title(title: Column) -> Column:
    return title_parts(title)["base"]


def adapter_title(title: Column) -> Column:
    """The workspace adapter's own title key: lower-cased, without a v-number, one stale word in brackets, and a version number."""
    out = F.lower(strip(title))
    for pattern in (r"\s*\bv\d+(?:\.\d+)*\s*$", r"\s*\((?:old|copy|archived|draft|backup)\)\s*$", r"\s*\bversion\s+\d+(?:\.\d+)*\s*$"):
        out = F.regexp_replace(out, rx(pattern), "")
    return strip(out)


def _field(names: str, value: str = r"\S.+?", end: str = r"(?:\n|$)") -> str:
    """A body line `Name: value`."""
    return rx(rf"(?:^|\n)\s*(?:{names})\s*[:]\s*({value}){end}")


STATUS = _field("Status", ".+?")
OWNER = _field(r"Owner|Maintained\s+by|DRI")
REVIEWED = _field(r"Last\s+reviewed", r"\d{4}-\d{2}-\d{2}", "")
REPLACED_BY = _field(r"Replaced\s+by|Superseded\s+by")
DEPRECATED = _field(r"Deprecated\s+as\s+of")
CANONICAL = _field("Canonical", "true|yes", r"\s*(?:\n|$)")
CADENCE = _field(r"Review\s+cadence")
APPLIES_TO = _field(r"Applies\s+to")
SCOPE = _field("Scope")
SCOPE_FIELDS = {
    "product": _field("Product"), "version": _field("Version"), "audience": _field("Audience"), "environment": _field("Environment"),
    "region": _field("Region"), "plan": _field("Plan"), "feature_state": _field(r"Feature\s+state"), "feature_flag": _field(r"Feature\s+flag"),
}


_NAMES = (
    r"Status|Owner|Maintained\s+by|DRI|Last\s+reviewed|Replaced\s+by|Superseded\s+by|Deprecated\s+as\s+of|Canonical|Review\s+cadence|Applies\s+to|Scope|"
    r"Product|Version|Audience|Environment|Region|Plan|Feature\s+state|Feature\s+flag"
)
_TO_LAST_FIELD = rx(rf"\A(?s:.*)(?:^|\n)\s*(?:{_NAMES})\s*[:]\s*[^\n]*")


def field_lines(content: Column) -> Column:
    """The text up to the end of its last field line; '' without one. Fields stand at the top of pages: the text is passed once
    for this, and each field is looked for in what is left."""
    return F.regexp_extract(content, _TO_LAST_FIELD, 0)


def body_metadata(content: Column) -> Column:
    """struct of the body's fields; last_reviewed is a date, null if impossible."""
    reviewed = F.try_to_timestamp(found(content, REVIEWED), F.lit("yyyy-MM-dd")).cast("date")
    return F.struct(
        found(content, STATUS).alias("status_text"), found(content, OWNER).alias("owner"), reviewed.alias("last_reviewed"), found(content, REPLACED_BY).alias("replaced_by"),
        found(content, DEPRECATED).alias("deprecated_as_of"), F.coalesce(content.rlike(CANONICAL), F.lit(False)).alias("canonical"), found(content, CADENCE).alias("review_cadence"), found(content, APPLIES_TO).alias("applies_to"),
    )


def applicability(content: Column) -> Column:
    """map of the scope fields: each from its own line or else from a `Scope: key=value; ...` line, whose first wins."""
    pairs = F.transform(F.split(F.coalesce(found(content, SCOPE), F.lit("")), ";"), lambda p: F.split(p, "=", 2))
    pairs = F.filter(pairs, lambda p: (F.size(p) == 2) & (strip(F.get(p, 1)) != ""))

    def compact(key: str) -> Column:
        mine = F.filter(pairs, lambda p: F.replace(F.lower(strip(F.get(p, 0))), F.lit(" "), F.lit("_")) == key)
        return strip(F.get(F.get(mine, 0), 1))

    entries = [F.struct(F.lit(k).alias("key"), F.coalesce(found(content, p), compact(k)).alias("value")) for k, p in SCOPE_FIELDS.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def coexist(a: Column, b: Column) -> Column:
    """Whether two scopes share a field with different values."""
    both = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.coalesce(F.exists(both, lambda k: F.lower(strip(F.element_at(a, k))) != F.lower(strip(F.element_at(b, k)))), F.lit(False))


def version_key(title: Column, content: Column) -> Column:
    """The highest version named in the title or the first 500 characters, as an array of numbers; null without one."""
    text = F.concat(title, F.lit(" "), F.substring(content, 1, 500))
    named = F.concat(all_found(text, rx(r"\bv(\d+(?:\.\d+)*)\b")), all_found(text, rx(r"\bversion\s+(\d+(?:\.\d+)*)\b")))
    return F.array_max(F.transform(named, lambda v: F.transform(F.split(v, r"\."), lambda n: n.try_cast("decimal(38,0)"))))


def references(content: Column) -> Column:
    """Titles behind `see` and then those behind `refer to`, up to a line end, full stop, comma or semicolon."""
    found_ = F.concat(all_found(content, rx(r"(?:For (?:more )?(?:details|information),?\s+)?see:?\s+([^\n.,;]+)")), all_found(content, rx(r"refer\s+to:?\s+([^\n.,;]+)")))
    return F.filter(F.transform(found_, strip), lambda r: r != "")


def urls(content: Column, listed: Column) -> Column:
    """The distinct web addresses of a page: listed ones and those in the text, without workspace-internal ones."""
    inside = F.transform(all_found(content, rx(r"https?://[^\s<>\"')]+", fold=False), 0), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    listed = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda u: u.startswith("http"))
    return F.filter(F.array_distinct(F.concat(listed, inside)), lambda u: ~u.rlike(r"^https?://(?:www\.)?(?:notion\.so|(?:app\.)?notion\.com)/"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def finding_key(source_type: Column, doc_id: Column, status: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source_type, doc_id, status), 256), 1, 24)


def sanitized_error(error: Column) -> Column:
    """An error text without credentials, at most 500 characters."""
    names = "token|api[_-]?key|password|passwd|secret|credential"  # fixed values
    out = F.regexp_replace(error, rx(r"\b(Bearer|Basic)\s+\S+"), "$1 [REDACTED]")
    for mark, put in (("=", "="), (":", ": ")):
        out = F.regexp_replace(out, rx(rf"\b({names})\s*{mark}\s*[^&\s]+"), f"$1{put}[REDACTED]")
    out = F.regexp_replace(out, rx(rf"([?&](?:{names})=)[^&\s]+"), "$1[REDACTED]")
    return F.substring(out, 1, 500)
