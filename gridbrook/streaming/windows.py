"""Streaming counterparts of the temporal aggregations, with the results of the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(stream: DataFrame, ts: str, x: str, by: list[str], step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(by, lower, upper, n, total, mean) of tumbling windows; rows later than ``late`` behind the newest are dropped."""
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = marked.groupBy(F.window(ts, step).alias("w"), *by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"))
    return out.select(*by, F.col("w.start").alias("lower"), F.col("w.end").alias("upper"), "n", "total", "mean")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take what is there, write it as Parquet and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def recession(stream: DataFrame, by: list[str], ts: str, x: str, carry: float, gain: float) -> DataFrame:
    """(by, ts, value, state): state = carry * state + gain * value, kept for each series across micro-batches.

    Rows of a batch are taken in the order of their time; a stream must bring them in that order from batch to batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), f"{ts} {kinds[ts]}", "value double", "state double"])

    def step(key, parts, state):
        now = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(ts, kind="stable")
        out = []
        for v in rows[x].astype(float):
            now = carry * now + gain * v
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({**{c: rows[c].to_numpy() for c in by}, ts: rows[ts].to_numpy(), "value": rows[x].astype(float).to_numpy(), "state": out})

    return stream.groupBy(*by).applyInPandasWithState(step, schema, "state double", "append", GroupStateTimeout.NoTimeout)
