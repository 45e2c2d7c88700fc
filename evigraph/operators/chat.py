"""Threads, messages and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_tail(messages: DataFrame, n: int = 6, chars: int = 1600) -> DataFrame:
    """thread_id, ord, history: the last ``n`` messages before each one, clipped; null for the first."""
    before = Window.partitionBy("thread_id").orderBy("ord").rowsBetween(-n, -1)
    tail = F.collect_list(F.substring("text", 1, chars)).over(before)
    return messages.select("thread_id", "ord", F.when(F.size(tail) > 0, F.array_join(tail, " / ")).alias("history"))


def threads_by_recency(messages: DataFrame) -> DataFrame:
    return messages.groupBy("thread_id").agg(F.max("ord").alias("updated")).orderBy(F.desc("updated"), "thread_id")


def messages_in_order(messages: DataFrame, thread_id: int) -> DataFrame:
    return messages.filter(F.col("thread_id") == thread_id).orderBy("ord")


def latest_job(jobs: DataFrame) -> DataFrame:
    """project_id, status of its last job by time, then id."""
    return jobs.groupBy("project_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
