"""Log levels as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has

# fixed values: spellings of levels; anything else is info
SPELLINGS = {
    "debug": ("debug", "3", "10", "20"),
    "warn": ("warn", "warning", "1", "40"),
    "error": ("error", "0", "50"),
    "fatal": ("fatal", "critical", "60"),
}


def normalize_level(raw: Column) -> Column:
    key = F.lower(F.trim(raw.cast("string")))
    out = F.when(key.isin(*SPELLINGS["debug"]), "debug")
    for level in ("warn", "error", "fatal"):
        out = out.when(key.isin(*SPELLINGS[level]), level)
    return out.otherwise("info")


def level_from_message(message: Column) -> Column:
    lower = F.lower(message)
    return (
        F.when(has(lower, "error|fail|exception|timeout", False), "error").when(lower.contains("warn"), "warn").when(has(lower, "debug|trace", False), "debug").otherwise("info")
    )


def level_from_status(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")


def is_error(level: Column) -> Column:
    return level.isin("error", "fatal")
