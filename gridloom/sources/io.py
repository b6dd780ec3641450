"""Sources and sinks: delimited text, legends, manifests, arrays, geometry, resumable and atomic writes."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import slug


def read_csv(spark: SparkSession, path: str | list[str], schema: str, **options: str) -> DataFrame:
    """CSV with a declared schema; nothing is inferred. Bad fields are null."""
    return spark.read.options(header="true", mode="PERMISSIVE", **options).schema(schema).csv(path)


def read_decimal_comma(spark: SparkSession, path: str, names: list[str], numbers: list[str], missing=("", "/", "-", "NA"), encoding: str = "windows-1252") -> DataFrame:
    """Semicolon text in a national encoding with decimal commas; the year comes from the file's name."""
    # the reader knows Latin-1, from which windows-1252 differs in the bytes 0x80 to 0x9f alone
    cp1252 = encoding.lower() in ("windows-1252", "cp1252")
    raw = spark.read.options(header="true", sep=";", encoding="iso-8859-1" if cp1252 else encoding).schema(", ".join(f"`{n}` string" for n in names)).csv(path).withColumn("__file", F.col("_metadata.file_name"))
    if cp1252:
        codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
        raw = raw.select(*[F.translate(n, "".join(map(chr, codes)), bytes(codes).decode("cp1252")).alias(n) for n in names], "__file")
    value = lambda c: F.when(~F.trim(F.col(c)).isin(*missing), F.regexp_replace(F.trim(F.col(c)), ",", ".")).try_cast("double")
    cols = [value(c).alias(c) if c in numbers else F.trim(F.col(c)).alias(c) for c in names]
    return raw.select(*cols, F.regexp_extract("__file", "(\\d{4})", 1).try_cast("int").alias("year"))


def read_legend(spark: SparkSession, path: str, prefix: str = "count_") -> DataFrame:
    """Tab text of code and label, with the column name that each label gives."""
    return spark.read.options(sep="\t", header="true").schema("code int, label string").csv(path).withColumn("column_name", F.concat(F.lit(prefix), slug("label")))


def read_union(spark: SparkSession, paths: list[str], fmt: str = "parquet", source: str = "source_file") -> DataFrame:
    """Files read as one table, with the name of each row's file; absent columns are null."""
    reader = spark.read.format(fmt)
    reader = reader.option("mergeSchema", "true") if fmt == "parquet" else reader
    return reader.load(paths).withColumn(source, F.col("_metadata.file_name"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame, if it has all these columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_selected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The wanted columns that exist: the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def read_manifest(spark: SparkSession, manifest: DataFrame, path: str = "path", limit: int | None = None) -> DataFrame:
    """All Parquet files that a manifest lists (a list of files is small), in order of their paths."""
    paths = [r[0] for r in manifest.select(path).distinct().orderBy(path).collect()]
    return spark.read.parquet(*paths[:limit])


def map_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Files of any format, each parsed by a function (path, bytes) -> rows; a file that fails to parse gives no
    rows. Formats without an offline library (swath and grid archives) plug in here."""
    return map_contents(spark.read.format("binaryFile").load(path), parse, schema)


def map_contents(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """The same for files held as rows (path, content)."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows: list[dict] = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += list(parse(p, bytes(content)))
                except (ValueError, KeyError, OSError):
                    continue
            if rows:
                yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, schema)


def parse_npz(path: str, content: bytes) -> Iterator[dict]:
    """Rows (id, shard, local_index) of an array shard with an `ids` member."""
    import numpy as np

    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        for k, i in enumerate(z["ids"].tolist()):
            yield {"id": int(i), "shard": path.rsplit("/", 1)[-1], "local_index": k}


def shard_index(spark: SparkSession, path: str) -> DataFrame:
    """id -> (shard, local index); an id in two places is an error."""
    return contents_index(spark.read.format("binaryFile").load(path))


def contents_index(files: DataFrame) -> DataFrame:
    """The same for array shards held as rows (path, content)."""
    index = map_contents(files, parse_npz, "id bigint, shard string, local_index bigint")
    if index.groupBy("id").count().filter("count > 1").limit(1).count():
        raise ValueError("an id is in two shards")
    return index


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of polygon collections: properties, and the outer ring as arrays of longitude and latitude."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    f = spark.read.option("multiLine", "true").schema(schema).json(path).select(F.explode("features").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select("f.properties.*", F.transform(ring, lambda p: p[0]).alias("lon"), F.transform(ring, lambda p: p[1]).alias("lat"))


def valid_range(x: str, low: float, high: float, scale: float = 1.0) -> Column:
    return F.when(F.col(x).between(low, high), F.col(x) * scale)


def flatten_corners(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Two arrays of four corners as eight columns; shorter arrays give nulls."""
    cols = [F.get(F.col(c), k).alias(f"{n}_corner{k + 1}") for n, c in (("Lat", lat), ("Lon", lon)) for k in range(4)]
    return df.select("*", *cols)


def write_shards(df: DataFrame, path: str, rows: int = 16) -> None:
    """Parquet shards of a fixed number of rows at most."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(path)


def write_pair(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}.csv")


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").parquet(path)


def write_json(spark: SparkSession, path: str, data: dict) -> None:
    """Small metadata as one JSON file, through Spark's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(data, sort_keys=True, indent=1).encode()))
    out.close()


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, kind, folder) of the complete versions of a table, in order. A folder without its _SUCCESS mark is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for f in fs.listStatus(root):
        part = f.getPath().getName().split("-")
        if len(part) == 3 and part[0] == "v" and fs.exists(hadoop.Path(f.getPath(), "_SUCCESS")):
            found.append((int(part[1]), part[2], f.getPath().toString()))
    return sorted(found)


def add_version(df: DataFrame, path: str, number: int | None = None, kind: str = "full") -> None:
    """Write the next version of a table, or the one of a given number (again, if it is there). Nothing is renamed: a
    version counts once Spark has marked its folder as complete, so readers see the old or the new table, and a crash
    at any point leaves the old one. What the full version before the last one no longer needs is removed."""
    spark = df.sparkSession
    before = _versions(spark, path)
    number = number if number is not None else (before[-1][0] + 1 if before else 1)
    df.write.mode("overwrite").parquet(f"{path}/v-{number:012d}-{kind}")
    fulls = [n for n, k, _ in before if k == "full" and n < number]
    if kind == "full" and fulls:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for n, _, folder in before:
            if n < fulls[-1]:
                old = hadoop.Path(folder)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def replace_atomically(df: DataFrame, path: str) -> None:
    """A new full version of a table; `read_current` reads the last complete one."""
    add_version(df, path)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The last full version of a table and the deltas after it, as they were written."""
    held = _versions(spark, path)
    last = max((n for n, k, _ in held if k == "full"), default=-1)
    return spark.read.parquet(*[f for n, k, f in held if n > last or (n == last and k == "full")])


def has_version(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))
