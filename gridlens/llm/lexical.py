"""Ranked lexical search over a length-stratified index.

Documents with the same normaliser m form a stratum; m is the only part of a
score that depends on a document's length.  A stratum is stored in cells of at
most DOCS_PER_CELL documents.  Within a cell the postings of a term are grouped
by tf, so an impact is computed once per tf and not per posting.  The largest tf
of each term bounds what any document of the cell can score for an item.  A
search visits cells in the order of that bound and stops when it falls below the
item's tenth score.  A first round opens each task's best cells only and thereby
finds a tenth score over all tasks, which the second round starts from.  Nothing
is cut off: a cell stays closed only if it cannot hold a better document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import table, text_bytes, word_hashes, written

TOP = 10
LENGTH_SHARE = 90  # percent of the normaliser that follows the length
SATURATION = 8
DOCS_PER_CELL = 2048
TEXTS_AT_ONCE = 1000
BYTES_AT_ONCE = 4 << 20
BOUNDS_AT_ONCE = 4_000_000
ITEM_CHARS = 8_000_000  # characters of the items that are searched for together
_OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def term_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the terms of UTF-8 bytes in order, cut into runs between terms so that memory is bounded."""
    if len(data) <= BYTES_AT_ONCE:
        return word_hashes(data, _OUTSIDE)[0]
    parts, at = [], 0
    while at < len(data):
        end = at + BYTES_AT_ONCE
        gap = _OUTSIDE[data[end:]] if end < len(data) else np.zeros(0, dtype=bool)
        end = end + int(gap.argmax()) if gap.any() else len(data)
        parts.append(word_hashes(data[at:end], _OUTSIDE)[0])
        at = end
    return np.concatenate(parts)


def _lists(flat: np.ndarray, sizes: list[int] | np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)


def postings(docs: DataFrame, vocabulary: np.ndarray, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (doc_id, n, terms, tfs) of the documents with a term: n counts all terms, the arrays hold those of the
    vocabulary (sorted hashes) by position and how often they occur."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_column].dataType.simpleString()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                sizes, terms, tfs = [], [], []
                for data in text_bytes(batch.column("text")):
                    hashes = term_hashes(data)
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    term, tf = np.unique(place[known[place] == hashes], return_counts=True)
                    sizes.append(len(hashes))
                    terms.append(term)
                    tfs.append(tf)
                held = [len(t) for t in terms]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), _lists(_joined(terms, np.int32), held, pa.int32()), _lists(_joined(tfs, np.int32), held, pa.int32())],
                    ["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.mapInArrow(match, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")
    return written(rows.where("n > 0"), "postings")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; `size` numbers, whatever the size of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(total[term], pa.int64())], ["term", "df"])

    found = rows.select("terms").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["term"].to_numpy()] = found["df"].to_numpy()
    return out


def index(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Stored cells (m, doc_ids, terms, tfs, counts, places): per group of equal term and tf its documents' places in doc_ids.

    Rows are dealt by (m, row number), so a stratum of any size is spread; within a
    cell doc_ids ascend, nulls last.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    exact = f"cast(n as decimal(18,0)) * cast({LENGTH_SHARE * n_docs} as decimal(20,0)) div cast({n_terms} as decimal(20,0))"
    placed = rows.select("doc_id", (F.expr(exact) + (100 - LENGTH_SHARE)).alias("m"), "terms", "tfs", F.monotonically_increasing_id().alias("row"))
    # documents without a term of the vocabulary score nothing
    placed = placed.where(F.size("terms") > 0).repartitionByRange("m", "row").sortWithinPartitions("m", F.col("doc_id").asc_nulls_last(), "row")

    def cell(m: int, parts: list[pa.RecordBatch]) -> list:
        held = pa.Table.from_batches(parts)
        terms, tfs = held.column("terms").combine_chunks(), held.column("tfs").combine_chunks()
        sizes = np.diff(terms.offsets.to_numpy())
        term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
        place = np.repeat(np.arange(held.num_rows, dtype=np.int32), sizes)
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        return [m, held.column("doc_id").combine_chunks(), term[first], tf[first], np.diff(np.append(first, len(term))).astype(np.int32), place]

    def batch_of(cells: list[list]) -> pa.RecordBatch:
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(c[1]) for c in cells])]), pa.int32()), pa.concat_arrays([c[1] for c in cells]))
        numbers = [_lists(np.concatenate([c[k] for c in cells]), [len(c[k]) for c in cells], pa.int32()) for k in (2, 3, 4, 5)]
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int64()), ids, *numbers], ["m", "doc_ids", "terms", "tfs", "counts", "places"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last, cells, stored = [], 0, None, [], 0
        for batch in batches:
            batch = batch.select(["doc_id", "m", "terms", "tfs"])
            ms = batch.column("m").to_numpy()
            for at, end in zip(*_runs(ms)):
                while at < end:
                    if held and (ms[at] != last or held == DOCS_PER_CELL):
                        cells.append(cell(last, parts))
                        stored += len(cells[-1][5])
                        parts, held = [], 0
                        if stored > BOUNDS_AT_ONCE // 4:
                            yield batch_of(cells)
                            cells, stored = [], 0
                    take = min(int(end - at), DOCS_PER_CELL - held)
                    parts.append(batch.slice(at, take))
                    last, held, at = int(ms[at]), held + take, at + take
        if held:
            cells.append(cell(last, parts))
        if cells:
            yield batch_of(cells)

    schema = f"m long, doc_ids array<{kind}>, terms array<int>, tfs array<int>, counts array<int>, places array<int>"
    return written(placed.select("doc_id", "m", "terms", "tfs").mapInArrow(build, schema), "index")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.append(starts[1:], len(values))


@dataclass
class Items:
    """The terms of all items in one array (positions in the vocabulary), their weights, and where each item starts."""

    terms: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    size: int

    def bounds(self, best: np.ndarray) -> np.ndarray:
        """The most that each item can score, given the largest impact of each term."""
        return np.add.reduceat(self.weights * best[self.terms], self.starts)

    def of(self, item: int) -> slice:
        end = self.starts[item + 1] if item + 1 < len(self.starts) else len(self.terms)
        return slice(self.starts[item], end)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + SATURATION * m)


class Cell:
    """A cell of the index: one impact per group of equal term and tf, then scores of single items."""

    def __init__(self, m: int, doc_ids: pa.Array, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, places: np.ndarray):
        self.doc_ids, self.terms, self.places = doc_ids, terms, places
        self.impacts, self.counts = impacts(tfs, m), counts
        self.opened = None

    def best(self, out: np.ndarray) -> None:
        """Enters the largest impact of each term; tf ascends within a term."""
        out[self.terms] = self.impacts

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of each document for one item."""
        if self.opened is None:
            firsts, ends = _runs(self.terms)
            upto = np.concatenate([[0], np.cumsum(self.counts)])
            self.opened = {int(t): (upto[a], upto[b]) for t, a, b in zip(self.terms[firsts], firsts, ends)}
            self.spread = np.repeat(self.impacts, self.counts)
        out = np.zeros(len(self.doc_ids), dtype=np.int64)
        for term, weight in zip(terms.tolist(), weights.tolist()):
            if term in self.opened:
                a, b = self.opened[term]
                out[self.places[a:b]] += weight * self.spread[a:b]
        return out


def _cells(batch: pa.RecordBatch) -> Iterator[Cell]:
    columns = [batch.column(c) for c in ("doc_ids", "terms", "tfs", "counts", "places")]
    bounds = [c.offsets.to_numpy() for c in columns]
    flat = [columns[0].values, *[c.values.to_numpy() for c in columns[1:]]]
    for k, m in enumerate(batch.column("m").to_pylist()):
        yield Cell(m, *[v[b[k] : b[k + 1]] for v, b in zip(flat, bounds)])


def visited(cells: DataFrame, items: Items, least: np.ndarray, top: int, first_round: bool) -> DataFrame:
    """(item, doc_id, score) of documents that score at least `least` of their item, at most `top` of each opened cell.

    Per batch of cells each item visits them by falling bound, until the bound is
    below its `top`-th score so far; in the first round it visits one cell of a batch.
    """
    kind = cells.schema["doc_ids"].dataType.elementType
    shared = cells.sparkSession.sparkContext.broadcast((items, least))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, start = shared.value
        floor = np.maximum(start, 1)
        found: dict[int, list[int]] = {}
        best = np.zeros(wanted.size, dtype=np.int64)
        at_once = max(1, BOUNDS_AT_ONCE // len(wanted.starts))
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                opened = list(_cells(whole.slice(at, at_once)))
                bounds = np.empty((len(opened), len(wanted.starts)), dtype=np.int64)
                for k, one in enumerate(opened):
                    one.best(best)
                    bounds[k] = wanted.bounds(best)
                    best[one.terms] = 0
                order = np.argsort(-bounds, axis=0, kind="stable")[:1] if first_round else np.argsort(-bounds, axis=0, kind="stable")
                rows_item, rows_id, rows_score = [], [], []
                for item in np.flatnonzero(bounds.max(axis=0) >= floor):
                    own = wanted.of(item)
                    for k in order[:, item]:
                        if bounds[k, item] < floor[item]:
                            break
                        scores = opened[k].scores(wanted.terms[own], wanted.weights[own])
                        places = np.flatnonzero(scores >= floor[item])
                        if not len(places):
                            continue
                        places = places[np.lexsort((places, -scores[places]))[:top]]
                        so_far = sorted([*found.get(item, ()), *scores[places].tolist()], reverse=True)[:top]
                        found[item] = so_far
                        if len(so_far) == top:
                            floor[item] = max(floor[item], so_far[-1])
                        rows_item.append(np.full(len(places), item, dtype=np.int32))
                        rows_id.append(opened[k].doc_ids.take(pa.array(places)))
                        rows_score.append(scores[places])
                if rows_item:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(rows_item), pa.int32()), pa.concat_arrays(rows_id), pa.array(np.concatenate(rows_score), pa.int64())],
                        ["item", "doc_id", "score"],
                    )

    return cells.mapInArrow(search, f"item int, doc_id {kind.simpleString()}, score long")


def tenth_scores(rows: DataFrame, items: int, top: int) -> np.ndarray:
    """Per item the `top`-th score of the rows (item, score); 0 where there are fewer."""
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc())
    best = rows.select("item", "score").withColumn("k", F.row_number().over(by_item)).where(F.col("k") <= top)
    out = np.zeros(items, dtype=np.int64)
    for r in best.where(F.col("k") == top).select("item", "score").collect():
        out[r["item"]] = r["score"]
    return out


def _searched(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, top: int) -> DataFrame:
    """ranked() for items (item_id, text) that fit the driver."""
    spark = docs.sparkSession
    kinds = (wanted.schema["item_id"].dataType.simpleString(), docs.schema[id_column].dataType.simpleString())
    nothing = spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    rows = wanted.collect()
    hashes = [np.unique(term_hashes(np.frombuffer((r["text"] or "").encode(), dtype=np.uint8))) for r in rows]
    rows, hashes = [r for r, h in zip(rows, hashes) if len(h)], [h for h in hashes if len(h)]
    if not rows:
        return nothing
    vocabulary = np.unique(np.concatenate(hashes))
    held = postings(docs, vocabulary, id_column, text)
    total = held.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return nothing
    df = document_frequencies(held, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    terms = np.searchsorted(vocabulary, np.concatenate(hashes))
    starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])[:-1]
    items = Items(terms, weights[terms], starts, len(vocabulary))
    cells = index(held, total["docs"], total["terms"])
    none = np.zeros(len(rows), dtype=np.int64)
    least = tenth_scores(visited(cells, items, none, top, True), len(rows), top)
    found = visited(cells, items, least, top, False)
    by_item = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item int, item_id {kinds[0]}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `top` documents with the highest scores above 0.

    Null texts have no terms; items without terms and empty tables give no rows.
    Documents are rows: equal ids rank each on their own, null ids behind others of
    the same score.  Repeated items rank once, equal ids with other texts each.
    Other columns are left out.  Items are searched for in blocks of ITEM_CHARS
    characters, each with an index of its own terms over all documents; a block's
    terms and weights are what the tasks are sent.
    """
    wanted = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).distinct()
    chars = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // ITEM_CHARS
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        part = _searched(docs, wanted.where(block == k), id_column, text, top)
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), s AS (
  SELECT CAST(count(*) AS BIGINT) AS dn, CAST(sum(len(ws)) AS BIGINT) AS dl FROM d WHERE len(ws) > 0
), q AS (
  SELECT DISTINCT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * dn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, dn
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * dn) // dl))))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
