"""Entry filters; Catalyst combines them and pushes them to the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    levels: tuple[str, ...] = ()
    after_ms: int | None = None
    before_ms: int | None = None
    user_id: str | None = None
    request_id: str | None = None


def apply_filter(entries: DataFrame, wanted: Filter) -> DataFrame:
    """Level in a list, time between inclusive bounds, user equal, request or trace equal."""
    if wanted.levels:
        entries = entries.filter(F.col("level").isin(*wanted.levels))
    if wanted.after_ms is not None:
        entries = entries.filter(F.col("ms") >= wanted.after_ms)
    if wanted.before_ms is not None:
        entries = entries.filter(F.col("ms") <= wanted.before_ms)
    if wanted.user_id is not None:
        entries = entries.filter(F.col("user_id") == wanted.user_id)
    if wanted.request_id is not None:
        entries = entries.filter((F.col("request_id") == wanted.request_id) | (F.col("trace_id") == wanted.request_id))
    return entries


def build_filter(levels: str | None = None, after: str | None = None, before: str | None = None, user: str | None = None, request: str | None = None) -> Filter:
    """From command-line text; dates that cannot be read are ignored."""
    from datetime import datetime, timezone

    def ms(text: str | None) -> int | None:
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
        except ValueError:
            return None
        return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000) if at else None

    return Filter(tuple(x.strip() for x in levels.split(",")) if levels else (), ms(after), ms(before), user, request)
