"""Streams: curation of arriving files, event-time windows, stateful counts and exactly-once sinks.

A stream's position is its checkpoint: a stopped query resumes after the last
committed batch, and a batch that is run again overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import words
from ..operators import quality


def files(spark: SparkSession, path: str, schema, per_batch: int = 16, kind: str = "parquet") -> DataFrame:
    """A stream of files as they arrive, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(path)


def curated(docs: DataFrame, limits=quality.DOCUMENT) -> DataFrame:
    """The stateless quality filter, on a stream as on a table."""
    return quality.filter_documents(docs, limits=limits)


def _timed(rows: DataFrame, time: str = "ts") -> DataFrame:
    """Event time as an instant: watermarks don't take local times."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(rows: DataFrame, key: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """First rows of each key within the watermark: state is dropped once rows can't come any more."""
    return _timed(rows, time).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def joined(left: DataFrame, right: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams with one key, the right one at most ``within`` after the left."""
    a = _timed(left).withWatermark("ts", late).select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = _timed(right).withWatermark("ts", late).select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    return a.join(b, F.expr(f"l_{key} = r_{key} and r_ts >= l_ts and r_ts <= l_ts + interval {within}"))


def running_counts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, n, total) so far, kept by arbitrary state: one update a key and batch."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def packed(rows: DataFrame, group: str, order: str, size: str, room: int) -> DataFrame:
    """Next-fit packing over a stream: (group, order, bin, offset); the open bin of a group lives in its state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(k, frames, state):
        at, used = state.get if state.exists else (-1, room + 1)
        frame = pd.concat(list(frames)).sort_values(order)
        bins, offsets = [], []
        for n in frame[size].fillna(0).astype(int):
            if used + n > room:
                at, used = at + 1, 0
            bins.append(at)
            offsets.append(used)
            used += n
        state.update((at, int(used)))
        yield pd.DataFrame({group: [k[0]] * len(bins), order: frame[order].to_numpy(), "bin": bins, "offset": offsets})

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandasWithState(update, f"{group} {kinds[group]}, {order} {kinds[order]}, bin long, offset long", "bin long, used long", "append", GroupStateTimeout.NoTimeout)


def start(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", once: bool = True):
    """Write a stream as Parquet; ``once`` handles what has arrived and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).option("path", out).format("parquet")
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_batches(stream: DataFrame, out: str, checkpoint: str, partition: str | None = None):
    """Each batch to a folder of its own, overwritten if it is run again: exactly once without a transactional sink."""

    def write(batch: DataFrame, number: int) -> None:
        w = batch.write.mode("overwrite")
        (w.partitionBy(partition) if partition else w).parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
