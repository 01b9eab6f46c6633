"""Inputs: source trees, index tables, baselines, manifests, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.findings import language_of

#: What a scan leaves out by default.
EXCLUDED_EXTENSIONS = ("jpg", "png", "gif", "mp4", "avi", "mkv", "zip", "tar", "gz", "exe", "dll", "so")
EXCLUDED_DIRS = ("node_modules", ".git", "target", ".vscode", ".idea", "build", "dist")
MAX_BYTES = 16 << 20


def source_files(spark: SparkSession, root: str, include: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, content, length, hash, lang of the files under a root that a scan looks at.

    Size and name are tested on the listing, before any content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", include) if include else reader).load(root).where(F.col("length") <= max_bytes)
    files = files.where(~F.col("path").rlike(r"/(" + "|".join(d.replace(".", r"\.") for d in EXCLUDED_DIRS) + ")/") & ~F.lower("path").rlike(r"\.(" + "|".join(EXCLUDED_EXTENSIONS) + ")$"))
    lang = language_of(F.col("path"), F.decode(F.substring("content", 1, 256), "ISO-8859-1"))
    return files.select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("hash"), lang.alias("lang")).where(~is_binary(F.col("content")))


def is_binary(content) -> Column:
    """More than one percent of NUL bytes, in whole percents."""
    nul = F.length(content) - F.length(F.unhex(F.regexp_replace(F.regexp_replace(F.hex(content), "(..)", "$1,"), "00,|,", "")))
    return F.floor(nul * 100 / F.greatest(F.length(content), F.lit(1))) > 1


def changed(files: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """What the index does not hold as it is now: path with hash, or path with time."""
    return files.join(index.select(*keys), keys, "left_anti")


def read_jsonl(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """Rows of a JSON-lines log; broken rows, and rows of another schema version, are left out."""
    df = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).where("_broken IS NULL").drop("_broken")
    return df.where(F.col("schema_version") == version) if version is not None else df


def decode_payload(table: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON payload column as a struct; rows that don't decode are dropped, not fatal."""
    return table.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"})).where(F.col(column).isNotNull())
