"""Load files by type and list folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.sources.images import read_images

# File suffixes by kind.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp")
KIND_BY_SUFFIX = {
    ".csv": "csv",
    ".xlsx": "excel",
    ".xls": "excel",
    ".json": "json",
    ".txt": "text",
    **dict.fromkeys(IMAGE_SUFFIXES, "image"),
}


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Header row, empty cell = missing.  Without a schema types are inferred in
    an extra pass.

    Quoted cells may hold line breaks; where they do not, ``multi_line=False``
    lets Spark split one large file over many tasks.
    """
    reader = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("nullValue", "")
    )
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(
    spark: SparkSession, path: str, schema: str | None = None, lines: bool = False
) -> DataFrame:
    """An array of records per file, or one record per line."""
    reader = spark.read.option("multiLine", not lines)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def suffix_of(path: Column) -> Column:
    """Lower-cased suffix with its dot, '' without one; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^./](\.[^./]+)$", 1))


def kind_of(path: Column) -> Column:
    """image, csv, excel, json, text or unknown, by suffix."""
    suffix = suffix_of(path)
    kind = None
    for s, k in KIND_BY_SUFFIX.items():
        kind = F.when(suffix == s, k) if kind is None else kind.when(suffix == s, k)
    return kind.otherwise("unknown")


def file_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, modified, kind) of the files in a folder, contents unread."""
    return spark.read.format("binaryFile").load(folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        kind_of(F.col("path")).alias("kind"),
    )


def detect_kind(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return KIND_BY_SUFFIX.get(name[dot:].lower(), "unknown") if dot > 0 else "unknown"


def auto_load(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True, unknown_as: str = "unknown"
) -> tuple[DataFrame, str]:
    """Load by suffix; returns the rows and dataframe, image or text.

    ``schema`` saves CSV and JSON the pass that infers types; without
    ``multi_line`` they have one record per line and can be split.  A file of
    unknown suffix raises, unless ``unknown_as`` names the kind to read it as.
    """
    kind = detect_kind(path)
    if kind == "unknown" and not path.rstrip("/").endswith(".parquet"):
        kind = unknown_as
    if kind == "csv":
        return read_csv(spark, path, schema, multi_line), "dataframe"
    if kind == "json":
        return read_json(spark, path, schema, lines=not multi_line), "dataframe"
    if kind == "image":
        return read_images(spark, path), "image"
    if kind == "text":
        return read_text(spark, path), "text"
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path), "dataframe"
    raise ValueError(f"unsupported file type: {kind} ({path})")
