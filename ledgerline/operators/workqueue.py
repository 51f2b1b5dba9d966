"""A resumable work queue over state tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import next_eligible
from ledgerline.sources.upserts import merge_rows

T = TypeVar("T")
RETRY = ("quota_exhausted", "api_error")
DONE = ("complete", "zero_comments", "comments_disabled")


def buckets(state: DataFrame, commented: DataFrame, now: Column, key: str = "video_id", due_col: str = "next_eligible", force: bool = False) -> DataFrame:
    """Adds has_comments and bucket: 1 never fetched and 2 due to retry, both
    without comments, 3 the same with comments, 5 finished and due again, 6
    forced, 99 not now. The keys with comments are joined once, as a flag."""
    flags = commented.select(key).distinct().withColumn("__has", F.lit(True))
    s = state.join(flags, key, "left").withColumn("has_comments", F.coalesce("__has", F.lit(False))).drop("__has")
    new = F.col("status").isNull() | (F.col("status") == "pending")
    due = F.col(due_col).isNull() | (F.col(due_col) <= now)
    retry = F.col("status").isin(*RETRY) & due
    bare = ~F.col("has_comments")
    return s.withColumn("bucket", F.when(new & bare, 1).when(retry & bare, 2).when(new, 3).when(retry, 3).when(F.col("status").isin(*DONE) & due, 5).when(F.lit(force), 6).otherwise(99))


def candidates(state: DataFrame, commented: DataFrame, now: Column, n: int, key: str = "video_id", due_col: str = "next_eligible", force: bool = False) -> DataFrame:
    """The first n entries to work on, by bucket, without comments first, then
    by due time and key (a total order, so reruns agree)."""
    b = buckets(state, commented, now, key, due_col, force)
    return b.where(F.col("bucket") < (99 if force else 6)).orderBy("bucket", "has_comments", F.col(due_col).asc_nulls_first(), key).limit(n)


def record_outcomes(state: DataFrame, outcomes: DataFrame, now: Column, key: str = "video_id", refresh_days: int = 30, backoff_hours: int = 24) -> DataFrame:
    """State after a run: status, error and due time are the outcome's, success
    time, title and count stay if it has none."""
    news = outcomes.withColumn("next_eligible", next_eligible(F.col("status"), now, refresh_days, backoff_hours).cast(dict(state.dtypes)["next_eligible"]))
    return merge_rows(state, news, key, overwrite=["status", "last_error", "next_eligible", "last_attempted"], keep_old=["discovered_at"])


def unscored(comments: DataFrame, scored: DataFrame, key: str = "comment_id", order: str = "published_at", n: int | None = None) -> DataFrame:
    """Comments without a score yet, oldest first."""
    todo = comments.join(scored.select(key), key, "left_anti").orderBy(order, key)
    return todo if n is None else todo.limit(n)


def completion(state: DataFrame, by: str | None = None) -> DataFrame:
    """Counts of pending, completed and retryable entries."""
    g = state.groupBy(by) if by else state.groupBy()
    return g.agg(F.count("*").alias("total"), F.count_if(F.col("status").isNull() | (F.col("status") == "pending")).alias("pending"), F.count_if(F.col("status").isin(*DONE)).alias("completed"), F.count_if(F.col("status").isin(*RETRY)).alias("retryable"))


class QuotaExhausted(Exception):
    """A service refused every attempt for its quota."""


def with_backoff(call: Callable[[], T], is_quota: Callable[[Exception], bool], attempts: int = 5, base_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result. After an error for the quota it waits base_delay, twice
    that, and so on, and tries again; any other error goes through at once, and
    QuotaExhausted follows the last attempt. For readers of services on the driver."""
    last = None
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if not is_quota(error):
                raise
            last = error
            sleep(base_delay * 2**attempt)
    raise QuotaExhausted(f"no quota after {attempts} attempts") from last
