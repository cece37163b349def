"""Images as rows; pixel bytes come in the order blue, green, red."""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the OpenCV pixel types.
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "webp")
MODE_NAMES = {0: "L", 16: "RGB", 24: "RGBA"}


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, loaded, reason): every file of the folder and whether it came in as an image.

    A file is not loaded if its name is of no image, or its bytes do not decode.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = spark.read.format("binaryFile").load(path)
    # Spark's reader lists all files but reads no row from an empty one
    listed = spark.createDataFrame([(unquote(f),) for f in found.inputFiles()], "path string").select(plain("path").alias("path"))
    sizes = found.select(plain("path").alias("path"), F.col("length").alias("_n"))
    files = listed.join(sizes, "path", "left").select("path", F.coalesce("_n", F.lit(0).cast("long")).alias("size_bytes"))
    decoded = read_images(spark, path).select(plain("path").alias("path"), F.lit(True).alias("_ok"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = (
        F.when(~suffix.isin(*SUFFIXES), F.concat(F.lit("no image suffix: "), suffix))
        .when(suffix == "webp", F.lit("no decoder for webp"))
        .when(F.col("size_bytes") == 0, F.lit("empty file"))
        .otherwise(F.lit("does not decode"))
    )
    return files.join(decoded, "path", "left").select(
        "path", "size_bytes", F.col("_ok").isNotNull().alias("loaded"), F.when(F.col("_ok").isNull(), reason).alias("reason")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, mode, data); files that do not decode are
    left out, and :func:`load_report` names them."""
    return (
        spark.read.format("image").option("dropInvalid", True).load(path)
        .select(
            F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
            F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
            F.col("image.mode").alias("mode"), F.col("image.data").alias("data"),
        )
    )


def image_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, resolution, mode, brightness, size_kb) of the images that decode."""

    @F.pandas_udf("double")
    def brightness(data: pd.Series, channels: pd.Series) -> pd.Series:
        means = [
            np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)[:, :3].mean()
            for raw, n in zip(data, channels)
        ]
        return pd.Series(means, dtype="float64")

    sizes = spark.read.format("binaryFile").load(path).select(
        F.regexp_replace("path", "^file:/+", "/").alias("_p"), F.col("length").alias("bytes")
    )
    name = None
    for number, text in MODE_NAMES.items():
        hit = F.col("mode") == number
        name = F.when(hit, text) if name is None else name.when(hit, text)
    images = read_images(spark, path).withColumn("_p", F.regexp_replace("path", "^file:/+", "/"))
    return images.join(sizes, "_p").select(
        "path",
        F.format_string("%d×%d", "width", "height").alias("resolution"),
        name.otherwise("other").alias("mode"),
        F.round(brightness("data", "channels"), 1).alias("brightness"),
        F.round(F.col("bytes") / 1024, 1).alias("size_kb"),
    )
