"""Writing: shards, splits, resumable partitions, provenance, tar and token files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import contiguous_shards, rank_all


def parquet(rows: DataFrame, path: str, most_rows: int = 0, partition: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    writer = writer.option("maxRecordsPerFile", most_rows) if most_rows else writer
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def sharded(rows: DataFrame, path: str, key: str, size: int, held_shards: int = 2) -> None:
    """Runs of ``size`` rows by key, the first shards as ``valid``: folders split=/shard_id=."""
    parquet(contiguous_shards(rows, key, size, held_shards), path, partition=["split", "shard_id"])


def resumable(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that ``rows`` holds; run again after a failure, it ends with the same files."""
    rows.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def text_list(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().write.mode("overwrite").text(path)


def table_as(rows: DataFrame, name: str, bucket: str | None = None, buckets: int = 16) -> None:
    """A table in the catalog, bucketed for joins by the same key without a shuffle."""
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, bucket).sortBy(bucket) if bucket else writer).saveAsTable(name)


def provenance(rows: DataFrame, path: str, **facts) -> None:
    """One JSON line beside a result: what it came from, its columns and count."""
    spark = rows.sparkSession
    held = rows.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(rows.columns))).withColumn("spark", F.lit(spark.version))
    for k, v in facts.items():
        held = held.withColumn(k, F.lit(str(v)))
    held.write.mode("overwrite").json(path)


def latest_submission(generations: DataFrame, questions: DataFrame, key: str, step: str = "opt_step") -> DataFrame:
    """Each question's generation of the greatest step, questions without one kept."""
    best = generations.groupBy(key).agg(F.max_by(F.struct(*[c for c in generations.columns if c != key]), step).alias("g"))
    return questions.join(best.select(key, "g.*"), key, "left")


def token_files(rows: DataFrame, key: str, tokens: str, most: int) -> DataFrame:
    """``rows`` with ``file_id``: files of about ``most`` tokens in hash order of the key.

    Files are hash ranges sized from the total, so no task orders the whole corpus.
    """
    total = rows.agg(F.sum(F.size(tokens)).alias("t")).first()["t"] or 0
    n = max(1, -(-total // most))
    return rows.withColumn("file_id", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def tar_members(rows: DataFrame, key: str, shard: str, members: dict[str, str]) -> DataFrame:
    """(shard, tar: bytes): one tar a shard, with a member key.extension for each column in ``members``."""
    names = list(members.items())

    def run(group, table):
        import io
        import tarfile

        import pyarrow as pa

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for row in table.sort_by(key).to_pylist():
                for ext, column in names:
                    value = row[column]
                    data = value if isinstance(value, bytes) else b"" if value is None else str(value).encode()
                    info = tarfile.TarInfo(f"{row[key]}.{ext}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pa.table({shard: pa.array([group[0].as_py()], table.schema.field(shard).type), "tar": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy(shard).applyInArrow(run, f"{shard} {dict(rows.dtypes)[shard]}, tar binary")


def with_position(rows: DataFrame, key: str, name: str = "position") -> DataFrame:
    """A number from 0 in order of a natural key: positions that don't depend on partitions."""
    return rank_all(rows, key).withColumn(name, F.col("rank") - 1).drop("rank")
