"""Scans beyond plain tables: JSON and CSV with declared schemas, tar samples, catalogs, generators, settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines, gzip by name, with a declared schema; lines that don't fit become nulls."""
    return spark.read.schema(schema).json(path)


def json_list(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file that is one JSON list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def mixture_file(spark: SparkSession, path: str, schema) -> DataFrame:
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if path.endswith(".json"):
        return json_list(spark, path, schema)
    raise ValueError(f"neither .json nor .jsonl: {path}")


def csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def external_table(spark: SparkSession, name: str, path: str, partitions: list[str] | None = None) -> DataFrame:
    """A Parquet folder as a table in the catalog, its partitions found."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{path}'")
    if partitions:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def schema_of(described) -> T.DataType:
    """A schema from nested Python: names of types, lists of one type, dicts of fields."""
    if isinstance(described, dict):
        return T.StructType([T.StructField(k, schema_of(v)) for k, v in described.items()])
    if isinstance(described, list):
        return T.ArrayType(schema_of(described[0]))
    return T._parse_datatype_string(described)


def tar_samples(spark: SparkSession, path: str) -> DataFrame:
    """(key, files: map of extension to bytes) from tar files whose members are named key.extension.

    A member's key ends at the first dot of its base name; an archive is read by one task.
    """

    def run(batches):
        import io
        import tarfile

        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: dict[str, list] = {}
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for m in tar:
                        if m.isfile():
                            head, _, base = m.name.rpartition("/")
                            stem, _, ext = base.partition(".")
                            held.setdefault(f"{head}/{stem}" if head else stem, []).append((ext, tar.extractfile(m).read()))
                for key, files in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key]), pa.array([files], pa.map_(pa.string(), pa.binary()))], names=["archive", "key", "files"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInArrow(run, "archive string, key string, files map<string, binary>")


def complete_samples(samples: DataFrame, listed: str = "metadata.txt") -> DataFrame:
    """Samples that hold every file named in their list, one name a line."""
    wanted = F.filter(F.split(F.element_at("files", F.lit(listed)).cast("string"), r"\s+"), lambda x: x != "")
    return samples.where(F.size(F.array_except(wanted, F.map_keys("files"))) == 0)


def decode_json_member(samples: DataFrame, member: str, schema: str, name: str = "value") -> DataFrame:
    return samples.withColumn(name, F.from_json(F.element_at("files", F.lit(member)).cast("string"), schema))


def cone(catalog: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Points within ``radius`` degrees: a band in declination that the scan can push down, then the exact distance."""
    d = F.degrees(2 * F.asin(F.sqrt(F.pow(F.sin(F.radians(F.col("dec") - dec) / 2), 2) + F.cos(F.radians("dec")) * F.cos(F.radians(F.lit(dec))) * F.pow(F.sin(F.radians(F.col("ra") - ra) / 2), 2))))
    return catalog.where(F.col("dec").between(dec - radius, dec + radius)).where(d <= radius)


def synthetic(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Records keyed by their number: the same number gives the same record, however it is partitioned."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return spark.range(n).select("id", (u(1) * 360).alias("ra"), (F.degrees(F.asin(2 * u(2) - 1))).alias("dec"), F.when(u(3) < 0.9, u(4) * 3).alias("z"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000.0).alias("flux"))


def settings(text: str) -> dict:
    """Settings from JSON, or from YAML where that library is there."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def file_ranges(requests: DataFrame, path: str, file: str = "file", offset: str = "offset", length: str = "length") -> DataFrame:
    """``requests`` with ``data``, the bytes of a file (its base name) from an offset on, and ``error`` where they can't be had.

    Only files that are asked for are read, each once however many ranges it
    has; ranges are cut by the scan's own column, without Python.
    """
    wanted = requests.select(F.col(file).alias("__name")).distinct()
    held = requests.sparkSession.read.format("binaryFile").load(path).withColumn("__name", F.element_at(F.split("path", "/"), -1)).join(wanted, "__name", "left_semi")
    ranged = requests.join(held.select("__name", "content"), F.col(file) == F.col("__name"), "left")
    at, n = F.col(offset), F.col(length)
    inside = (at >= 0) & (n >= 0) & (at + n <= F.length("content"))
    error = F.when(F.col("content").isNull(), "no such file").when(~F.coalesce(inside, F.lit(False)), "range beyond the file")
    return ranged.select(*requests.columns, F.when(error.isNull(), F.substring("content", (at + 1).cast("int"), n.cast("int"))).alias("data"), error.alias("error"))
