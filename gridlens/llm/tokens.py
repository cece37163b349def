"""Token ids in ORC files, and exact token-length histograms."""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import scratch, table

CACHED_WORDS = 400_000
CACHED_IDS = 4_000_000
WORDS_AT_ONCE = 4096
ROWS_AT_ONCE = 1000
LAST_MARKS = r"(\pL)([!-/:-@\[-`{-~]+)( |$)"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.stripe.size": str(32 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id {kind}, shard int, start long, n_tokens long, tokens array<int>"


@functools.lru_cache(maxsize=1)
def marked_letters() -> str:
    """Pattern of combining marks, and of letters that are composed or lower-cased to one with such a mark at its end."""
    letters = [c for c in map(chr, range(0x30000)) if unicodedata.category(c).startswith("L")]
    marked = [c for c in letters if unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1]).startswith("M")]
    return rf"[\pM{''.join(marked)}]"


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Encodes texts by the tokenizers library, word by word.

    The tokenizer drops white space, lower-cases and never joins letters with other
    characters, so the ids of a text are those of its pieces between blanks in order,
    and ASCII punctuation after a letter at a piece's end is a piece of its own.  The
    ids of known words lie in one pool; texts are gathered from it as arrays.  A text
    with "<|", which may spell a special token, is encoded as a whole.  ASCII letters are
    lower-cased and marks cut off before, to know fewer words, but not in a text with
    combining marks or letters that become one: the tokenizer composes first, a mark may
    compose with the small letter only, and it stays with the punctuation after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marked = marked_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, pieces: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of the pieces, as arrays to be joined, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return [np.array(x, dtype=np.uint32) for x in found], [len(x) for x in found]

    def _word_ids(self, words: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """The same for words of letters: encoded in one text, where each should be one token group."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(words))
        if len(sizes) != len(words):  # a letter that normalises to more than letters
            return self._ids(words)
        return [np.array(found.ids, dtype=np.uint32)], sizes.tolist()

    def _learn(self, new: list[str]) -> None:
        words = [w for w in new if w.isalpha()]
        others = [w for w in new if not w.isalpha()]
        parts, sizes = [], []
        for pieces, ids_of in ((words, self._word_ids), (others, self._ids)):
            for at in range(0, len(pieces), WORDS_AT_ONCE):
                ids, counts = ids_of(pieces[at : at + WORDS_AT_ONCE])
                parts += ids
                sizes += counts
        self.known.update(zip(words + others, range(len(self.known), len(self.known) + len(new))))
        self.pool = np.concatenate([self.pool, *parts])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.array(sizes, dtype=np.int64))])

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by end_id, and its bounds; null is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring(texts, "<|")
        plain = pc.if_else(whole, "", texts)
        marked = pc.match_substring_regex(plain, self.marked)
        plain = pc.replace_substring(plain, "\n", " ")
        plain = pc.if_else(marked, plain, pc.replace_substring_regex(pc.ascii_lower(plain), LAST_MARKS, r"\1 \2\3"))
        split = pc.split_pattern(plain, " ")
        coded = split.values.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS or len(self.pool) > CACHED_IDS:
            self._forget()
            new = pieces
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))[coded.indices.to_numpy()]
        sizes = self.bounds[at + 1] - self.bounds[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.bounds[at] - ends[:-1], sizes)]
        bounds = ends[split.offsets.to_numpy()]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False))[::-1]:
            own = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            ids = np.insert(ids, bounds[k], own)
            bounds[k + 1 :] += len(own)
        return np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> PieceEncoder:
    """One encoder for all tasks of a Python worker, so that a word is encoded once per worker."""
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, files: int | None = None, text: str = "text") -> None:
    """Writes doc_id and token ids, in ascending doc_id order (null first), as ORC files below `path`.

    Each file is one shard: a range of ids, sorted.  `start` counts the ids of the
    shard before a document, so whole-table offsets need only one sum per shard.
    Integers are run-length encoded; every 2,000 rows have an index entry and a
    Bloom filter on doc_id, so a reader takes stripes in parallel and skips those
    that hold none of the wanted ids.  A null or empty text has the end id only.
    Rows with equal ids are all written; other columns are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first()]
    rows = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, bounds = encoder.batch(batch.column("text"), end_id)
                n = batch.num_rows
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column("doc_id"), pa.array(np.full(n, shard), pa.int32()), pa.array(start + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), tokens]
                start += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "start", "n_tokens", "tokens"])

    rows.mapInArrow(encode, FILE_SCHEMA.format(kind=kind)).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The written rows with `start` counted over all shards; filters on doc_id reach the files."""
    rows = spark.read.schema(FILE_SCHEMA.format(kind=id_type)).orc(path)
    sizes = rows.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_base"))
    # one row per shard, and shards are as many as the writer's partitions: small however long the texts are
    joined = rows.join(F.broadcast(bases), F.col("shard") == F.col("_shard"))
    return joined.select("doc_id", (F.col("start") + F.col("_base")).alias("start"), "tokens")


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows with an array of ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer or word_bpe_path())
    return read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString())


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(encoded(table(spark, folder, "documents")))


# Lengths


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _byte_bpe(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LONG_TEXT = 200_000
_BREAK = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S)(?= \S)")


def token_length(encoding, text: str | None) -> int:
    """Tokens of the whole text; very long ones are encoded between words, where the pattern always splits."""
    if not text:
        return 0
    if len(text) <= LONG_TEXT:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        cut = _BREAK.search(text, at + LONG_TEXT)
        end = cut.start() if cut else len(text)
        total += len(encoding.encode_ordinary(text[at:end]))
        at = end
    return total


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): how many documents have each encoded length; null and empty texts have length 0."""
    path = path or byte_bpe_path()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        encoding = _byte_bpe(path)
        for batch in batches:
            # copies in a batch are encoded once
            values = pc.value_counts(batch.column(0))
            for value, n in zip(values.field("values"), values.field("counts").to_pylist()):
                length = token_length(encoding, value.as_py())
                counts[length] = counts.get(length, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["length", "n_docs"])

    lengths = docs.select(F.col(text).alias("text")).mapInArrow(measure, "length long, n_docs long")
    return lengths.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame, bucket: int = 512) -> DataFrame:
    """For every occurring length, taken as the context limit: exact totals from suffix sums.

    docs_over and tokens_over are of the longer documents; truncated_total is the
    number of tokens if every document is cut at the limit; quantile is the share
    of documents that fit.  Suffix sums run per bucket of lengths, and buckets are
    summed on their own.  An empty table gives no rows.
    """
    rows = histogram.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_bucket", F.floor(F.col("length") / bucket))
    later = Window.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    sums = rows.groupBy("_bucket").agg(F.sum("n_docs").alias("_docs"), F.sum("tokens").alias("_tokens"))
    sums = sums.select(
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_docs").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(everything).alias("total_docs"),
        F.sum("_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("_bucket").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda name: F.coalesce(F.sum(name).over(inside), F.lit(0))
    rows = rows.join(sums, F.col("_bucket") == F.col("_b"))
    rows = rows.withColumn("docs_over", over("n_docs") + F.col("_docs_after")).withColumn("tokens_over", over("tokens") + F.col("_tokens_after"))
    return rows.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_over",
        "tokens_over",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("truncated_total"),
        (1 - F.col("docs_over") / F.col("total_docs")).alias("quantile"),
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return length_report(length_histogram(table(spark, folder, "documents")))
