"""Sentiment of texts: any scorer, or one trained on labelled texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.columns import quoted
from gridlens.operators.text import non_blank
from gridlens.session import materialise

SHOWN_CHARS = 80
# in UTF-8: A-Z lower-cased, ASCII characters but letters and digits as spaces, all others as they are
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
FREQUENT = 200_000  # words that are sent to every task
LIMIT = 30.0  # log odds beyond which a score is as good as sure
POSITIVE, NEGATIVE = "POSITIVE", "NEGATIVE"


def _record(kept: list[str], text: Column, label: Column, score: Column) -> list[Column]:
    """The output contract: text as shown, label, percentage, score to 4 digits."""
    return [
        *[quoted(c) for c in kept],
        F.substring(text, 1, SHOWN_CHARS).alias("text"),
        label.alias("sentiment"),
        F.format_string("%.1f%%", score * 100).alias("confidence"),
        F.round(score, 4).alias("score"),
    ]


def score_text(
    df: DataFrame, text: str, load: Callable[[], Callable[[pd.Series], pd.DataFrame]]
) -> DataFrame:
    """Score whole non-blank texts by a model of the caller.

    ``load`` runs once per task and returns a function from a series of texts
    to a frame with columns label and score.  Only the texts go to Python, and
    only label and score come back.
    """
    kept = [c for c in df.columns if c != text]
    ready = non_blank(df, text).withColumnRenamed(text, "_text")

    @F.pandas_udf("label string, score double")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            found = scorer(batch)
            yield pd.DataFrame({"label": found["label"].to_numpy(), "score": found["score"].to_numpy()})

    scored = ready.withColumn("_found", work("_text"))
    return scored.select(*_record(kept, F.col("_text"), F.col("_found.label"), F.col("_found.score")))


@dataclass
class SentimentModel:
    """Log odds of each word (word, odds, n: how often it was seen) as a table, and those of a text without known words."""

    words: DataFrame
    prior: float


def _words(text: str) -> list[bytes]:
    """Runs of letters, digits and other non-ASCII characters; A-Z lower-cased."""
    return text.encode().translate(_SPLIT).split()


def train_sentiment(df: DataFrame, text: str, label: str) -> SentimentModel:
    """Naive Bayes on a 0/1 label: how often each word stands in either kind, each count one more.

    Words are counted per batch of texts before they move; words and counts stay a
    table, so the vocabulary has no limit.
    """
    rated = df.where(quoted(label).isNotNull() & quoted(text).isNotNull()).select(
        (quoted(label) == 1).alias("good"), quoted(text).cast("string").alias("text")
    )
    texts = rated.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for good, one in zip(batch.column("good").to_pylist(), batch.column("text")):
                for word, n in Counter(_words(one.as_py())).items():
                    found.setdefault(word, [0, 0])[good] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in found], pa.string()), *[pa.array([n[k] for n in found.values()], pa.int64()) for k in (1, 0)]],
                ["word", "c1", "c0"],
            )

    counts = materialise(
        rated.mapInArrow(count, "word string, c1 long, c0 long").groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")),
        "word-counts",
    )
    sums = counts.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.count("*").alias("v")).first()

    def share(count: str, total: int | None) -> Column:
        return F.log((F.col(count) + 1).cast("double") / F.lit(float((total or 0) + sums["v"])))

    odds = counts.select(
        "word", (share("c1", sums["n1"]) - share("c0", sums["n0"])).alias("odds"), (F.col("c1") + F.col("c0")).alias("n"))
    return SentimentModel(odds, math.log((texts["good"] + 1) / (texts["bad"] + 1)))


def _known_to_all(words: DataFrame, most: int) -> int:
    """A count of at least which at most `most` words were seen, as a power of two; 1 if that are all words."""
    powers = words.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("words")).collect()
    least, held = 1 << 62, 0
    for r in sorted(powers, key=lambda r: -r["p"]):
        held += r["words"]
        if held > most:
            return least
        least = 1 << r["p"]
    return 1


def score_sentiment(model: SentimentModel, df: DataFrame, text: str, frequent: int = FREQUENT) -> DataFrame:
    """Score whole non-blank texts by the log odds of their words.

    The `frequent` words, which most of a text consists of, are sent to every task and
    added up where the text is.  Where the model has more words, the others leave the
    text, meet the word table, and are summed per text.
    """
    kept = [c for c in df.columns if c != text]
    least = _known_to_all(model.words, frequent)
    table = {r["word"].encode(): r["odds"] for r in model.words.where(F.col("n") >= least).select("word", "odds").collect()}
    known = df.sparkSession.sparkContext.broadcast(table)
    rare = least > 1

    @F.pandas_udf("odds double, rest array<string>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odds = known.value
        for batch in batches:
            sums, rest = [], []
            for one in batch:
                words = _words(one)
                found = [odds[w] for w in words if w in odds]
                sums.append(math.fsum(found))
                rest.append([w.decode() for w in words if w not in odds] if rare and len(found) < len(words) else [])
            yield pd.DataFrame({"odds": sums, "rest": rest})

    shown = non_blank(df, text).select(
        *[quoted(c) for c in kept], F.substring(quoted(text), 1, SHOWN_CHARS).alias("_text"), work(quoted(text)).alias("_found"))
    total = F.col("_found.odds")
    if rare:
        shown = materialise(shown.withColumn("_row", F.monotonically_increasing_id()), "texts")
        others = model.words.where(F.col("n") < least).select("word", "odds")
        met = shown.select("_row", F.explode("_found.rest").alias("word")).join(others, "word")
        shown = shown.join(met.groupBy("_row").agg(F.sum("odds").alias("_odds")), "_row", "left")
        total = total + F.coalesce(F.col("_odds"), F.lit(0.0))
    odds = F.lit(model.prior) + total
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), odds))))
    scored = shown.withColumn("_p", p)
    return scored.select(
        *_record(kept, F.col("_text"), F.when(F.col("_p") >= 0.5, POSITIVE).otherwise(NEGATIVE),
                 F.greatest(F.col("_p"), 1 - F.col("_p")))
    )


def sentiment_counts(scored: DataFrame) -> DataFrame:
    """(sentiment, texts): positive against everything else."""
    side = F.when(F.col("sentiment") == POSITIVE, "Positive").otherwise("Negative")
    return scored.groupBy(side.alias("sentiment")).agg(F.count("*").alias("texts"))
