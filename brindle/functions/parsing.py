"""Parsing and formatting of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_number(c: Column, kind: str = "double") -> Column:
    """A number, or null if the trimmed text is not one."""
    return F.trim(c).try_cast(kind)


def population(c: Column) -> Column:
    """A population as people write it: "~12.500", "1,234", "300+", "5 000".

    Marks of approximation go, thousands separators of either kind go, and of
    the rest the digits count, with a minus that comes before them.
    """
    text = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"^[~≈≅]+", ""), r"\++$", "")
    text = F.when(~text.contains("."), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    digits = F.regexp_replace(text, r"[^0-9]", "")
    minus = F.when(text.rlike(r"^[^0-9]*-"), "-").otherwise("")
    return F.when(digits != "", F.concat(minus, digits).try_cast("long"))


def speed_kmh(c: Column) -> Column:
    """Whole km/h of a posted speed; mph are converted and truncated."""
    number = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(c).contains("mph"), F.floor(number * 1.60934)).otherwise(F.floor(number)).cast("int")


def first_int(c: Column) -> Column:
    """The leading whole number of lanes, levels and the like."""
    return F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int")


def metres(c: Column) -> Column:
    """A height such as "12", "12.5 m" or "40 ft" in metres."""
    number = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.lower(c).rlike(r"ft|feet|'"), number * 0.3048).otherwise(number)


def convert_distance(value: Column, from_unit: str, to_unit: str) -> Column:
    # Metres per unit.
    per = {"m": 1.0, "km": 1000.0, "mi": 1609.344}
    return value * (per[from_unit] / per[to_unit])


#: What stands for a missing or zero time.
NO_TIME = "\u2014"


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long").cast("string")


def duration(ms: Column) -> Column:
    """"5s", "1m 30s" or "1h 1m", in whole units; a dash for null and 0."""
    s = F.floor(ms / 1000)
    return (
        F.when(ms.isNull() | (ms == 0), NO_TIME)
        .when(s < 60, F.concat(_whole(s), F.lit("s")))
        .when(s < 3600, F.concat(_whole(s / 60), F.lit("m "), _whole(s % 60), F.lit("s")))
        .otherwise(F.concat(_whole(s / 3600), F.lit("h "), _whole(s % 3600 / 60), F.lit("m")))
    )


def duration_long(ms: Column) -> Column:
    """H:MM:SS, with the days before it if there are any; a dash for null and 0."""
    s = F.floor(ms / 1000)
    two = lambda c: F.lpad(_whole(c), 2, "0")
    tail = F.concat(F.lit(":"), two(s % 3600 / 60), F.lit(":"), two(s % 60))
    days = F.concat(_whole(s / 86400), F.lit(":"), two(s % 86400 / 3600), tail)
    return F.when(ms.isNull() | (ms == 0), NO_TIME).when(s >= 86400, days).otherwise(F.concat(_whole(s % 86400 / 3600), tail))


def ago(then_ms: Column, now_ms: Column) -> Column:
    """"45s ago", "2m ago", "3h 5m ago" or "1d 2h ago", a second unit of 0 left
    out; a dash for null and 0, "just now" for times to come."""
    s = F.floor((now_ms - then_ms) / 1000)

    def two(size: int, unit: str, part: int, part_unit: str) -> Column:
        rest = F.floor(s % size / part)
        return F.concat(_whole(s / size), F.lit(unit), F.when(rest > 0, F.concat(F.lit(" "), _whole(rest), F.lit(part_unit))).otherwise(""), F.lit(" ago"))

    return (
        F.when(then_ms.isNull() | (then_ms == 0), NO_TIME)
        .when(s < 0, "just now")
        .when(s < 60, F.concat(_whole(s), F.lit("s ago")))
        .when(s < 3600, F.concat(_whole(s / 60), F.lit("m ago")))
        .when(s < 86400, two(3600, "h", 60, "m"))
        .otherwise(two(86400, "d", 3600, "h"))
    )


def file_size(n: Column) -> Column:
    out = F.when(n.isNull(), "").when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        if power < 3:
            out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / float(1024**power)))
        else:
            out = out.otherwise(F.format_string(f"%.1f {unit}", n / float(1024**power)))
    return out


def namespace_of(name: Column) -> Column:
    """All but the last part of a dotted name."""
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("system.unnamespaced")


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def backoff_ms(retries: Column, base: int = 5000, most: int = 300_000) -> Column:
    """base * 2^retries, at most ``most``; large counts do not overflow."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(retries, F.lit(40))), F.lit(float(most))).cast("long")


def url_key(url: Column) -> Column:
    """A URL without fragment, trailing slash and case of scheme and host."""
    bare = F.substring_index(url, "#", 1)
    head = F.lower(F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1))
    rest = F.substr(bare, F.length(head) + 1)
    return F.concat(head, F.regexp_replace(rest, r"/+$", ""))


def file_kind(path: Column) -> Column:
    # Document types by extension.
    kinds = {"pdf": "pdf", "doc": "word", "docx": "word", "txt": "text", "md": "text", "html": "html", "htm": "html", "csv": "table", "xlsx": "table", "json": "data", "xml": "data"}
    found = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(found, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))
