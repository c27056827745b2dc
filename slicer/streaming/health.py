"""Health states of a table or stream of samples, and row rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slicer.control import Health, Sample, Thresholds, evaluate
from slicer.functions.identifiers import MYSQL, POSTGRES


def raw_class(t: Thresholds) -> Column:
    """The state of a sample by itself; null if the probe failed. Columns as in ``Sample``."""
    mysql, pg, c = F.col("engine") == MYSQL, F.col("engine") == POSTGRES, F.col
    paused = (mysql & ((c("history_list") > t.history_pause) | F.coalesce(c("replica_lag") > int(t.max_lag), F.lit(False)))) | (pg & ((c("lock_waiters") >= t.lock_waiters) | (c("oldest_transaction") > t.max_lag)))
    backoff = (mysql & (c("history_list") > t.history_backoff)) | (pg & ((c("io_waiters") >= t.io_waiters) | (c("oldest_transaction") > t.max_lag / 2)))
    return F.when(c("error").isNotNull(), F.lit(None).cast("string")).when(paused, Health.PAUSED.value).when(backoff, Health.BACKOFF.value).otherwise(Health.NORMAL.value)


def states(samples: DataFrame, cluster: str = "cluster", order: str = "at", thresholds: Thresholds | None = None) -> DataFrame:
    """``samples`` with their state: Resumed is a normal sample whose last good one was paused; failures repeat the last state."""
    by = Window.partitionBy(cluster).orderBy(order)
    before = F.last("__raw", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = F.when((F.col("__raw") == Health.NORMAL.value) & (F.col("__before") == Health.PAUSED.value), Health.RESUMED.value).otherwise(F.col("__raw"))
    rows = samples.withColumn("__raw", raw_class(thresholds or Thresholds())).withColumn("__before", before).withColumn("__own", own)
    state = F.coalesce(F.last("__own", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(Health.NORMAL.value))
    return rows.withColumn("state", state).drop("__raw", "__before", "__own")


STREAM = "cluster string, at timestamp, state string"


def stream_states(samples: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """The same for a stream of (cluster, at, and the columns of ``Sample``), with the last state kept for each cluster."""
    t = thresholds or Thresholds()

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = Health(state.get[0]) if state.exists else Health.NORMAL
        for part in parts:
            part, out = part.sort_values("at"), []
            for r in part.itertuples():
                lag = None if pd.isna(r.replica_lag) else int(r.replica_lag)
                error = None if r.error is None or r.error != r.error else r.error
                last, _ = evaluate(Sample(r.engine, error, int(r.history_list), lag, int(r.lock_waiters), int(r.io_waiters), float(r.oldest_transaction)), t, last)
                out.append(last.value)
            yield pd.DataFrame({"cluster": key[0], "at": part["at"], "state": out})
        state.update((last.value,))

    return samples.groupBy("cluster").applyInPandasWithState(update, STREAM, "state string", "append", GroupStateTimeout.NoTimeout)


def rows_per_second(rows: DataFrame, at: str = "ts", every: str = "1 second") -> DataFrame:
    """(start, rows) of each interval that has rows."""
    return rows.groupBy(F.window(at, every).alias("w")).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("start"), "rows")


def sample_counts(samples: DataFrame) -> DataFrame:
    """Samples over each limit, by cluster: conditional counts and maxima in one pass."""
    return samples.groupBy("cluster").agg(F.count_if(F.col("lock_waiters") > 0).alias("with_lock_waiters"), F.count_if(F.col("io_waiters") > 0).alias("with_io_waiters"), F.coalesce(F.max("oldest_transaction"), F.lit(0.0)).alias("oldest"))
