"""Best labels of a row from scores per class."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.arrays import softmax
from gridlens.functions.columns import quoted
from gridlens.operators.ranking import with_ordinal
from gridlens.session import materialise

BLOCK_CELLS = 4_000_000  # numbers of the centroids that are sent to the tasks together
BEST = "scores: array<double>, labels: array<string>, total: double"


def top_labels(df: DataFrame, scores: str, names: list[str], k: int = 5) -> DataFrame:
    """(other columns, rank, label, confidence, score) from an array of scores.

    Softmax over the scores, the k best; labels in title case with blanks for
    underscores.
    """
    kept = [c for c in df.columns if c != scores]
    shares = df.select(*[quoted(c) for c in kept], softmax(quoted(scores)).alias("_p"))
    ranked = F.sort_array(
        F.transform(F.col("_p"), lambda p, i: F.struct((-p).alias("neg"), i.alias("i")))
    )
    title = F.array(*[F.lit(n) for n in names])
    return shares.select(
        *[quoted(c) for c in kept], F.posexplode(F.slice(ranked, 1, k)).alias("_k", "_r")
    ).select(
        *[quoted(c) for c in kept],
        (F.col("_k") + 1).alias("rank"),
        F.initcap(F.replace(F.get(title, F.col("_r.i")), F.lit("_"), F.lit(" "))).alias("label"),
        F.format_string("%.2f%%", -F.col("_r.neg") * 100).alias("confidence"),
        F.round(-F.col("_r.neg"), 4).alias("score"),
    )


def class_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid): the mean vector of each class, one small state per task."""
    return (
        df.where(quoted(label).isNotNull())
        .groupBy(quoted(label).alias("label"))
        .agg(Summarizer.mean(array_to_vector(quoted(vector))).alias("m"))
        .select("label", vector_to_array("m").alias("centroid"))
    )


def _merged(shared, k: int):
    """Adds a block of classes to what a row has found so far."""

    @F.pandas_udf(BEST)
    def merge(vectors: pd.Series, best: pd.DataFrame) -> pd.DataFrame:
        matrix, own = shared.value
        dots = np.stack(vectors.to_numpy()).astype(np.float64) @ matrix
        top = np.argsort(-dots, axis=1, kind="stable")[:, :k]
        highest = dots.max(axis=1)
        total = highest + np.log(np.exp(dots - highest[:, None]).sum(axis=1))
        scores, labels_, sums = [], [], []
        for i, places in enumerate(top):
            mine = list(zip(dots[i, places].tolist(), [own[j] for j in places]))
            before = [] if best["total"].isna().iloc[i] else list(zip(best["scores"].iloc[i], best["labels"].iloc[i]))
            # earlier blocks come first among equals
            merged = sorted([*before, *mine], key=lambda x: -x[0])[:k]
            scores.append([x[0] for x in merged])
            labels_.append([x[1] for x in merged])
            sums.append(float(np.logaddexp(total[i], best["total"].iloc[i])) if before else float(total[i]))
        return pd.DataFrame({"scores": scores, "labels": labels_, "total": sums})

    return merge


def nearest_labels(
    df: DataFrame, vector: str, centroids: DataFrame, k: int = 5, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """(other columns, rank, label, confidence, score): the k classes whose centroid has the largest dot product.

    Scores are the softmax over all classes; labels in title case with blanks for
    underscores.  Classes come in blocks of at most ``block_cells`` numbers, one sent
    to the tasks after the other; a row carries its k best so far and the sum of the
    exponentials, so neither a row nor the driver holds all classes.
    """
    spark, kept = df.sparkSession, [c for c in df.columns if c != vector]
    first = centroids.select(F.size("centroid").alias("n")).first()
    if first is None:
        raise ValueError("no classes")
    per_block = max(1, block_cells // max(1, first["n"]))
    numbered = materialise(with_ordinal(centroids, "label", name="_at"), "centroids")
    blocks = -(-numbered.count() // per_block)
    out = df.withColumn("_best", F.lit(None).cast(f"struct<{BEST}>"))
    for b in range(blocks):
        inside = F.col("_at").between(b * per_block + 1, (b + 1) * per_block)
        rows = numbered.where(inside).orderBy("_at").select(F.col("label").cast("string").alias("label"), "centroid").collect()
        names = [r["label"] for r in rows]
        shared = spark.sparkContext.broadcast((np.array([r["centroid"] for r in rows], dtype=np.float64).T, names))

        out = out.withColumn("_best", _merged(shared, k)(quoted(vector), F.col("_best")))
    ranked = F.posexplode(F.arrays_zip("_best.scores", "_best.labels")).alias("_k", "_r")
    share = F.exp(F.col("_r.scores") - F.col("_total"))
    return out.select(*[quoted(c) for c in kept], F.col("_best.total").alias("_total"), ranked).select(
        *[quoted(c) for c in kept],
        (F.col("_k") + 1).alias("rank"),
        F.initcap(F.replace(F.col("_r.labels"), F.lit("_"), F.lit(" "))).alias("label"),
        F.format_string("%.2f%%", share * 100).alias("confidence"),
        F.round(share, 4).alias("score"),
    )
