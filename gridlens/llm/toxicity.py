"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed), a window the
mean of its words, and a softmax over two classes reads the window.  A document
scores as its most toxic window, since a few words in a long text are enough.
Training knows only the document's label: it starts with every window under that
label and then keeps, in toxic documents, the windows that score highest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import GAMMA, mix64, table

CACHED_WORDS = 150_000
NOTHING_KNOWN = -5.0  # log odds of texts without words, and of all texts without a model
LONG_WORD, PIECE, PIECE_STEP = 64, 16, 12
JOINTS = re.compile("[!-/:-@\\[-`{-~\u200b\u2060\ufeff]+")


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled rows of either class used for fitting, max_chars the length of such a row."""

    max_rows: int = 2000
    max_chars: int = 5000
    buckets: int = 1 << 16
    dim: int = 3
    shortest: int = 3
    longest: int = 5
    window: int = 4
    clean_windows: int = 16
    least_windows: int = 4
    prior: float = 100.0
    rate: float = 0.05
    steps: int = 40
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """Since window mean and softmax are linear, each n-gram has one number: its share of the log odds."""

    gram_score: np.ndarray
    bias: float
    settings: Settings


def words_of(text: str | None) -> list[str]:
    """Lower-case words without outer punctuation; empty for null.

    A word of more than LONG_WORD characters gives the parts between its ASCII marks and
    zero-width characters as words; a part that is still as long (scripts without
    spaces) gives consecutive pieces, which overlap, so that every n-gram of up to five
    characters lies in one.
    """
    words = [w for w in (x.strip(".,;:!?\"'()[]{}|*#%&$<>-_") for x in (text or "").lower().split()) if w]
    if all(len(w) <= LONG_WORD for w in words):
        return words
    parts = [p for w in words for p in ([w] if len(w) <= LONG_WORD else JOINTS.split(w)) if p]
    return [p for w in parts for p in ([w] if len(w) <= LONG_WORD else [w[k : k + PIECE] for k in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)])]


def gram_ids(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of <word> (the whole included), and the offsets per word."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(w) for w in marked], dtype=np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    codes = mix64((codes + np.uint64(1)) * GAMMA)
    ends = np.cumsum(sizes)
    word_at = np.repeat(np.arange(len(sizes)), sizes)
    room = ends[word_at] - np.arange(len(codes))
    found, owner = [], []
    value = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, settings.longest + 1):
        value = value[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] if n <= len(codes) else value[:0]
        if n >= settings.shortest:
            fits = np.flatnonzero(room[: len(value)] >= n)
            found.append(mix64(value[fits] + np.uint64(n)))
            owner.append(word_at[fits])
    whole = np.add.reduceat(codes * (np.arange(len(codes), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes) + np.uint64(3)) * GAMMA, ends - sizes)
    found.append(mix64(whole))
    owner.append(np.arange(len(sizes)))
    ids, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
    return (ids[order] % np.uint64(settings.buckets)).astype(np.int64), offsets


def _windows(n: int, size: int) -> np.ndarray:
    """Starts of all full windows of `size` words; one window for fewer words."""
    return np.arange(max(n - size + 1, 1))


def _side_by_side(n: int, size: int) -> np.ndarray:
    """Those that cover all words side by side; the last one is moved back to be full."""
    return np.unique(np.minimum(np.arange(0, max(n, 1), size), max(n - size, 0)))


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Trains on four fifths of the rows, sets the cut on the others."""
    test = [k % 5 == 4 for k in range(len(texts))]
    part = lambda values, wanted: [v for v, t in zip(values, test) if t == wanted]
    model = _trained(part(texts, False), part(labels, False), settings)
    rest = part(labels, True)
    return _calibrated(model, part(texts, True), rest) if 0 < sum(rest) < len(rest) and model.gram_score.any() else model


def _trained(texts: list[str], labels: list[int], settings: Settings) -> Model:
    """Joint gradient descent on n-gram vectors and softmax over all chosen windows.

    Without rows of both classes the model scores every text by the share of label 1.
    """
    rng = np.random.default_rng(settings.seed)
    vocabulary: dict[str, int] = {}
    rows, owner, truth = [], [], []
    for k, (text, label) in enumerate(zip(texts, labels)):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        if not ids:
            continue
        starts = _side_by_side(len(ids), settings.window)
        if not label and len(starts) > settings.clean_windows:
            starts = rng.choice(starts, settings.clean_windows, replace=False)
        for s in starts:
            rows.append(ids[s : s + settings.window])
            owner.append(k)
            truth.append(label)
    truth = np.array(truth, dtype=np.float64)
    base = float(np.clip(np.mean(labels), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    if not len(truth) or truth.min() == truth.max():
        return Model(np.zeros(settings.buckets), float(np.log(base / (1 - base))), settings)
    owner = np.array(owner)
    sizes = np.array([len(r) for r in rows])
    window_of = np.repeat(np.arange(len(rows)), sizes)
    word_of = np.fromiter((w for r in rows for w in r), dtype=np.int64, count=int(sizes.sum()))
    share = 1.0 / sizes[window_of]

    grams, offsets = gram_ids(list(vocabulary), settings)
    gram_word = np.repeat(np.arange(len(vocabulary)), np.diff(offsets))
    gram_share = 1.0 / np.diff(offsets)[gram_word]
    # n-grams that stand in very few windows tell nothing about unseen texts
    in_windows = np.bincount(word_of, minlength=len(vocabulary))
    used = np.bincount(grams, in_windows[gram_word], minlength=settings.buckets) >= settings.least_windows
    keep = used[grams]
    grams, gram_word, gram_share = grams[keep], gram_word[keep], gram_share[keep]

    positive = truth == 1
    dim = settings.dim
    vectors = rng.normal(0, 0.01, (settings.buckets, dim))
    softmax = np.zeros((dim, 2))
    softmax[:, 1], softmax[:, 0] = dim**-0.5, -(dim**-0.5)
    bias = np.zeros(2)
    spread = lambda at, weight, values, n: np.stack([np.bincount(at, weight * values[:, d], minlength=n) for d in range(values.shape[1])], axis=1)
    weight = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    moment = np.zeros_like(vectors)
    for step in range(settings.steps):
        if step == settings.steps // 2:
            # only the window of a toxic document that scores highest still counts as toxic
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, owner[positive], odds[positive])
            chosen = positive & (odds >= best[owner] - 1e-9)
            weight = np.where(chosen, 0.5 / chosen.sum(), 0.0) + np.where(positive, 0.0, 0.5 / (~positive).sum())
        if step in (0, settings.steps // 2):
            # curvature of the loss for each n-gram; the prior keeps rare ones near zero
            word_weight = np.bincount(word_of, weight[window_of] * share**2, minlength=len(vocabulary))
            curve = np.bincount(grams, gram_share**2 * word_weight[gram_word], minlength=settings.buckets)
            scale = 1.0 / (curve + settings.prior * np.median(curve[curve > 0]))[:, None]
        word_vector = spread(gram_word, gram_share, vectors[grams], len(vocabulary))
        window = spread(window_of, share, word_vector[word_of], len(rows))
        logits = window @ softmax + bias
        odds = logits[:, 1] - logits[:, 0]
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - truth) * weight
        d_logits = np.stack([-error, error], axis=1)
        d_word = spread(word_of, share, (d_logits @ softmax.T)[window_of], len(vocabulary))
        slope = spread(grams, gram_share, d_word[gram_word], settings.buckets)
        moment = 0.8 * moment + slope * scale
        vectors -= settings.rate * moment
        softmax -= 0.05 * window.T @ d_logits
        bias -= 0.5 * d_logits.sum(axis=0)
    direction = softmax[:, 1] - softmax[:, 0]
    return Model(vectors @ direction, float(bias[1] - bias[0]), settings)


def _calibrated(model: Model, texts: list[str], labels: list[int]) -> Model:
    """Scale and shift of the document's log odds, so that 0.3 splits the fitted classes with the fewest errors."""
    odds = Scorer(model).log_odds(texts)
    truth = np.array(labels)
    order = np.argsort(odds)
    wrong = np.concatenate([[0], np.cumsum(truth[order] == 1)]) + (truth == 0).sum() - np.concatenate([[0], np.cumsum(truth[order] == 0)])
    cuts = np.concatenate([[odds[order[0]] - 1], (odds[order][1:] + odds[order][:-1]) / 2, [odds[order[-1]] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = cuts[best[len(best) // 2]]
    return Model(model.gram_score, model.bias - float(cut) + float(np.log(0.3 / 0.7)), model.settings)


class Scorer:
    """Scores texts; the share of each word is kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        model, known = self.model, self.known
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = list({w for words in split for w in words})
        if new:
            ids, offsets = gram_ids(new, model.settings)
            sums = np.concatenate([[0.0], np.cumsum(model.gram_score[ids])])
            known.update(zip(new, ((sums[offsets[1:]] - sums[offsets[:-1]]) / np.diff(offsets)).tolist()))
        size, out = model.settings.window, np.empty(len(texts))
        for k, words in enumerate(split):
            if not words:
                out[k] = NOTHING_KNOWN
                continue
            values = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
            sums = np.concatenate([[0.0], np.cumsum(values)])
            starts = _windows(len(words), size)
            ends = np.minimum(starts + size, len(words))
            out[k] = ((sums[ends] - sums[starts]) / (ends - starts)).max() + model.bias
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits on at most max_rows labelled rows of either class (by the hash of the id), none of the held-out fold.

    Of conflicting labels of an id the largest counts, of several texts the least.  A
    class whose texts are all longer than max_chars is fitted on their first max_chars
    characters.  Where a class has no text at all, or no n-gram tells the classes
    apart, every document gets the same low score.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label")).where(~held_out(F.col("doc_id")))
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(settings.max_rows)
        sample = part if sample is None else sample.unionByName(part)

    def texts(wanted: DataFrame, fits: F.Column) -> pd.DataFrame:
        rows = docs.where(fits).select("doc_id", F.substring("text", 1, settings.max_chars).alias("text")).join(F.broadcast(wanted), "doc_id")
        return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).toPandas()

    short = F.length("text") <= settings.max_chars
    found = texts(sample, short)
    for label in {0, 1} - set(found["label"].astype(int)):
        found = pd.concat([found, texts(sample.where(F.col("label") == label), ~short)])
    found = found.sort_values(["doc_id", "text"], kind="stable")
    model = None
    if set(found["label"].astype(int)) >= {0, 1}:
        model = fit(found["text"].tolist(), found["label"].astype(int).tolist(), settings)
    if model is None or not model.gram_score.any() or not np.isfinite(model.bias):
        return Model(np.zeros(settings.buckets), NOTHING_KNOWN, settings)
    return model


def held_out(ident) -> F.Column:
    return F.crc32(ident.cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All rows and columns plus `column` (replaced if there): the probability of label 1 for the whole text.

    Null and empty texts get a low constant score.  Only the text is read.
    """
    # plain values, so that the executors need no import to read them
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_score, model.bias, asdict(model.settings)))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Model(shared.value[0], shared.value[1], Settings(**shared.value[2])))
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part.tolist()]
            yield pd.Series(np.concatenate([scorer.score(texts[k : k + 200]) for k in range(0, len(texts), 200)]) if texts else np.empty(0))

    return docs.withColumn(column, scored(F.col(text)))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
