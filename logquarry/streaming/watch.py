"""Watching a stream of lines: filter and tag, alerts with an exact cooldown, event-time counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import level_tag, line_time
from ..operators.alerts import Rule, match_rules

ALERTS = "rule string, severity string, ts timestamp, file string, line string, notified boolean"


def watch(lines: DataFrame, query: str | None = None, alert: str | None = None, width: int = 200) -> DataFrame:
    """Lines holding the query whatever its case, with tag and whether the alert pattern matches; stateless."""
    kept = lines if not query else lines.where(F.contains(F.lower("content"), F.lit(query.lower())))
    hit = F.col("content").rlike("(?i)" + alert) if alert else F.lit(False)
    return kept.select("file", F.substring("content", 1, width).alias("content"), level_tag(F.col("content")).alias("tag"), hit.alias("alert"))


def alerts_with_cooldown(lines: DataFrame, wanted: list[Rule], clock: Callable[[], float] = time.time) -> DataFrame:
    """Every alert of a stream; ``notified`` is false for those within the cooldown of the last one notified.

    State is one number for each rule and severity, and the time is the processing time of ``clock``.
    """
    found = match_rules(lines.withColumn("line_no", F.lit(0)), wanted).drop("line_no")

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for batch in batches:
            now, sent = clock(), []
            for cooldown in batch.cooldown:
                sent.append(last is None or now - last >= cooldown)
                last = now if sent[-1] else last
            yield batch[["rule", "severity", "ts", "file", "line"]].assign(notified=sent)
        if last is not None:
            state.update((last,))

    return found.groupBy("rule", "severity").applyInPandasWithState(judge, ALERTS, "last double", "append", GroupStateTimeout.NoTimeout)


def level_counts(lines: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Lines by event-time window and level; works on a stream (late lines up to the watermark) and on a table."""
    timed = lines.select(line_time(F.col("content")).alias("ts"), F.coalesce(level_tag(F.col("content")), F.lit("NONE")).alias("level")).where("ts IS NOT NULL")
    timed = timed.withWatermark("ts", late) if lines.isStreaming else timed
    return timed.groupBy(F.window("ts", width), "level").count().select(F.col("window.start").alias("start"), "level", F.col("count").alias("lines"))
