"""Column helpers that give regular expressions and strings their JavaScript meaning on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary between ASCII word characters; the JVM's own is Unicode-aware.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def js(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + pattern.replace(r"\b", BOUNDARY)


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the pattern occurs; false for null text."""
    return F.coalesce(text.rlike(js(pattern, ignore_case)), F.lit(False))


def capture(text: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The group's text of the first match, null without a match."""
    compiled = js(pattern, ignore_case)
    return F.when(has(text, pattern, ignore_case), F.regexp_extract(text, compiled, group))


def first_capture(texts: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """The capture of the first text of an array that matches."""
    compiled = js(pattern, ignore_case)
    return F.regexp_extract(F.get(F.filter(texts, lambda t: t.rlike(compiled)), F.lit(0)), compiled, group)


def any_has(texts: Column, pattern: str, ignore_case: bool = True) -> Column:
    compiled = js(pattern, ignore_case)
    return F.coalesce(F.exists(texts, lambda t: t.rlike(compiled)), F.lit(False))


def in_order(rows: Column, *fields: str) -> Column:
    """An array of structs by some of its fields; the others need no order of their own (maps have none)."""
    key = lambda x: F.struct(*[x[f] for f in fields])
    return F.array_sort(rows, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def truthy(text: Column) -> Column:
    """The text, or null where JavaScript would take it for false."""
    return F.nullif(text, F.lit(""))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def truncated(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def duration(ms: Column, zero: bool = False) -> Column:
    shown = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.1fs", ms / 1000.0))
    return F.when(ms == 0, F.lit("< 1ms")).otherwise(shown) if zero else shown


def clock(ms: Column) -> Column:
    """Time of day in UTC of epoch milliseconds."""
    second = F.pmod(F.floor(ms / 1000), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(second / 3600).cast("int"), F.floor(F.pmod(second, F.lit(3600)) / 60).cast("int"), F.pmod(second, F.lit(60)).cast("int"))
