"""Phrase collocations from a weighted de Bruijn graph.

Nodes are the grams one word shorter than the longest, edges the longest grams:
an edge leads from its first words to its last ones and weighs its occurrences.
One aggregate of the corpus gives all edges, and the shorter grams that end a
piece.  An occurrence of a node either goes on through an edge or ends a piece,
so the count of a node is the flow of its edges plus the ends, and likewise for
still shorter grams.  Nodes through which a single edge flows in and a single one
out carry the same weight as these edges; chains of them are compacted to paths
by pointer jumping, and such a node never stands as a phrase of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import table, text_bytes, written

PIECE_END = ".,;:!?\n\x0b\x0c\r"
LONGEST = 3
MIN_COUNT = 10
KEPT_PERCENT = 50
TOP = 2000
RUN_ROWS = 50_000  # sorted rows that are summed together
ENTRIES = 200_000  # grams that a task counts before it hands them on
WORDS_AT_ONCE = 100_000
SALTS = 16
TAB_FREE = (("\x01", "\x01a"), ("\t", "\x01b"))  # languages in keys
SAMPLED = 4000
BUSY = 10_000
# on the bytes of UTF-8: A-Z to a-z, what ends a piece to a line break, a tab to a blank
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_END.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(PIECE_END))
_EXACT = "decimal(16,0)"  # squares times a million fit 38 digits


def _count(words: list[str], longest: int, mark: str, counts: Counter) -> None:
    """Adds the longest gram that starts at each word as node, mark and last word; the last words start shorter ones."""
    n = len(words)
    for at in range(0, n - longest + 1, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + longest - 1]
        nodes = map(" ".join, zip(*[part[k:] for k in range(longest - 1)]))
        counts.update(map(mark.join, zip(nodes, part[longest - 1 :])))
    for k in range(1, min(longest - 1, n) + 1):
        counts[" ".join(words[n - k :]) + mark] += 1


def _replaced(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def _edges(docs: DataFrame, lang: str, text: str, longest: int) -> DataFrame:
    """(key, f): a key is a node, its language and the word of an edge, parted by tabs; an empty word says that a piece ends.

    Tasks count before they hand on, in a table of bounded size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["key", "f"])
        for batch in batches:
            for name, data in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                mark = f"\t{name}\t"
                for piece in data.tobytes().translate(_FOLD).decode().split("\n"):
                    if piece:
                        _count([w for w in piece.split(" ") if w], longest, mark, counts)
                if len(counts) > ENTRIES:
                    yield rows()
                    counts.clear()
        yield rows()

    safe = _replaced(F.coalesce(F.col(lang), F.lit("und")), *TAB_FREE)
    return docs.select(safe.alias("lang"), F.col(text).alias("text")).mapInArrow(count, "key string, f long")


def busy_nodes(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST) -> list[str]:
    """Nodes (with language) of over a BUSY-th of the words in about SAMPLED texts, under BUSY of them.  Only the work is dealt by them."""
    share = min(1.0, SAMPLED / max(1, docs.count()))
    found = _edges(docs.sample(share, 1) if share < 1 else docs, lang, text, longest)
    found = written(found.groupBy(F.substring_index("key", "\t", 2).alias("node")).agg(F.sum("f").alias("f")), "sampled")
    least = (found.agg(F.sum("f")).first()[0] or 0) / BUSY
    return [r["node"] for r in found.where(F.col("f") > least).select("node").collect()]


def _parts(column: pa.Array, from_end: bool) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first tab of each value, or the last one."""
    split = pc.split_pattern(column, "\t", max_splits=1, reverse=from_end)
    both = split.values if len(split) else pa.array([], pa.string())
    at = split.offsets.to_numpy()[:-1] if len(split) else np.empty(0, np.int64)
    return both.take(pa.array(at)), both.take(pa.array(at + 1))


def _run_starts(column: pa.Array) -> np.ndarray:
    differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs) + 1])


def graph(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """Stored (lang, gram, size, f): edges and nodes that occur min_count times or more, and all grams of fewer words.

    Only A-Z is lower-cased; a null language is ``und``, a null text empty.  Edges are
    dealt by node and sorted, so that one pass over a sorted stream sums each edge
    and each node's flow; rare ones only add to the counts of their first words.  The
    edges of a busy node lie in SALTS parts, whose sums are added up at the end.
    """
    busy = busy_nodes(docs, lang, text, longest)
    node = F.substring_index("key", "\t", 2)
    part = F.when(node.isin(busy), F.pmod(F.xxhash64("key"), F.lit(SALTS)) + 1).otherwise(0) if busy else F.lit(0)
    # sorted by numbers first: a node's edges follow each other, and mostly the nodes with the same first word
    order = F.expr("shiftleft(cast(hash(substring_index(key, ' ', 1)) as bigint), 32) | (hash(substring_index(key, '\t', 2)) & 4294967295L)")
    dealt = _edges(docs, lang, text, longest).repartition(node, part).withColumn("at", order).sortWithinPartitions("at", "key").select("key", "f")
    in_parts = pa.array(busy, pa.string())

    def rows_of(nodes: pa.Array, grams: pa.Array, sizes: int, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_parts(nodes, False)[1], grams, pa.array(np.full(len(f), sizes, dtype=np.int32)), pa.array(f, pa.int64())], ["lang", "gram", "size", "f"])

    def summed(keys: pa.Array, f: np.ndarray, in_runs: bool) -> Iterator[pa.RecordBatch]:
        """The sums of whole nodes; in_runs: of one node that is given piece by piece, so its flow is not known to be small."""
        first = _run_starts(keys)
        keys, f = keys.take(pa.array(first)), np.add.reduceat(f, first)
        nodes, words = _parts(keys, True)
        kept = pa.array(np.flatnonzero((f >= min_count) & pc.not_equal(words, "").to_numpy(zero_copy_only=False)))
        frequent = nodes.take(kept)
        yield rows_of(frequent, pc.binary_join_element_wise(_parts(frequent, False)[0], words.take(kept), " "), longest, f[kept.to_numpy()])

        first = _run_starts(nodes)
        nodes, f = nodes.take(pa.array(first)), np.add.reduceat(f, first)
        grams = _parts(nodes, False)[0]
        sizes = pc.count_substring(grams, " ").to_numpy() + 1
        whole = f >= (1 if in_runs or longest == 2 else min_count)
        whole |= pc.is_in(nodes, value_set=in_parts).to_numpy(zero_copy_only=False)
        whole = pa.array(np.flatnonzero(whole & (sizes == longest - 1)))
        yield rows_of(nodes.take(whole), grams.take(whole), longest - 1, f[whole.to_numpy()])
        for size in range(1, longest - 1):
            held = pa.array(np.flatnonzero(sizes >= size))
            split = pc.split_pattern(grams.take(held), " ")
            begin = split.offsets.to_numpy()[:-1]
            firsts = [split.values.take(pa.array(begin + k)) for k in range(size)]
            shorter = firsts[0] if size == 1 else pc.binary_join_element_wise(*firsts, " ")
            # grams with the same first words follow each other
            own = pc.binary_join_element_wise(shorter, _parts(nodes.take(held), False)[1], "\t")
            begin = _run_starts(own) if len(own) else np.empty(0, np.int64)
            own = own.take(pa.array(begin))
            yield rows_of(own, _parts(own, False)[0], size, np.add.reduceat(f[held.to_numpy()], begin) if len(begin) else np.empty(0, np.int64))
        pa.default_memory_pool().release_unused()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, f, in_runs = pa.array([], pa.string()), np.empty(0, np.int64), False
        for batch in batches:
            keys = pa.concat_arrays([keys, batch.column("key").cast(pa.string())])
            f = np.concatenate([f, batch.column("f").to_numpy()])
            if len(f) < RUN_ROWS:
                continue
            # the last node may go on, and if all are of one node its last edge may
            first = _run_starts(_parts(keys, True)[0])
            cut, one = int(first[-1]), False
            if in_runs and len(first) > 1:
                yield from summed(keys.slice(0, first[1]), f[: first[1]], True)
                keys, f, cut, in_runs = keys.slice(first[1]), f[first[1] :], cut - int(first[1]), False
            if not cut and len(f) >= RUN_ROWS:
                cut, one = int(_run_starts(keys)[-1]), True
            if cut:
                yield from summed(keys.slice(0, cut), f[:cut], one)
                keys, f, in_runs = pa.concat_arrays([keys.slice(cut)]), f[cut:], one
        if len(f) and in_runs:
            first = _run_starts(_parts(keys, True)[0])
            end = int(first[1]) if len(first) > 1 else len(f)
            yield from summed(keys.slice(0, end), f[:end], True)
            keys, f = keys.slice(end), f[end:]
        if len(f):
            yield from summed(keys, f, False)

    found = dealt.mapInArrow(reduce, "lang string, gram string, size int, f long").groupBy("lang", "gram", "size").agg(F.sum("f").alias("f"))
    found = found.where((F.col("size") < longest - 1) | (F.col("f") >= min_count) | (F.col("size") == 1))
    plain = _replaced(F.col("lang"), *[(new, old) for old, new in reversed(TAB_FREE)])
    return written(found.withColumn("lang", plain), "grams")


def compacted(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unary nodes, path places) of edges (lang, gram, f) and the flows of their nodes.

    A node is unary if one edge brings in all of its flow and one takes out all of
    it.  Places (lang, gram, head, step) say for each edge that follows a unary node
    where its path begins and how many edges lie before it; an edge without a row
    begins a path itself.  Pointers double each round, so a path of k edges takes
    log2(k) rounds.  There are no circles: a piece would have to start inside.
    """
    flow = nodes.select("lang", F.col("gram").alias("node"), F.col("f").alias("through"))
    full = lambda node, name: edges.select("lang", F.expr(node).alias("node"), F.col("gram").alias(name), "f").join(
        flow, ["lang", "node"]
    ).where("f = through").select("lang", "node", name)
    enters = full("substr(gram, length(substring_index(gram, ' ', 1)) + 2)", "enters")
    leaves = full("substr(gram, 1, length(gram) - length(substring_index(gram, ' ', -1)) - 1)", "leaves")
    unary = written(enters.join(leaves, ["lang", "node"]), "unary")
    places = unary.select("lang", F.col("leaves").alias("gram"), F.col("enters").alias("head"), F.lit(1).cast("long").alias("step"), F.lit(True).alias("moved"))
    while places.where("moved").take(1):
        jump = places.select("lang", F.col("gram").alias("head"), F.col("head").alias("_to"), F.col("step").alias("_more"))
        places = written(
            places.join(jump, ["lang", "head"], "left").select(
                "lang", "gram", F.coalesce("_to", "head").alias("head"), (F.col("step") + F.coalesce("_more", F.lit(0))).alias("step"), F.col("_to").isNotNull().alias("moved")),
            "places")
    return unary.select("lang", "node"), places.drop("moved")


def paths(edges: DataFrame, places: DataFrame) -> DataFrame:
    """(lang, phrase, n_edges, f): the compacted paths as text; a single edge is a path too.

    A path lies within one piece, so it is no longer than one text.
    """
    rows = edges.join(places, ["lang", "gram"], "left").select(
        "lang", F.coalesce("head", "gram").alias("head"), F.coalesce("step", F.lit(0).cast("long")).alias("step"), F.substring_index("gram", " ", -1).alias("word"), "f")
    found = rows.groupBy("lang", "head").agg(F.sort_array(F.collect_list(F.struct("step", "word"))).alias("steps"), F.min("f").alias("f"))
    rest = F.transform(F.filter("steps", lambda s: s["step"] > 0), lambda s: s["word"])
    return found.select("lang", F.concat_ws(" ", F.array("head"), rest).alias("phrase"), F.size("steps").alias("n_edges"), "f")


def _inner(phrase: Column, size: Column, longest: int) -> Column:
    """All shorter phrases of two or more words inside a phrase."""
    words = F.split(phrase, " ")

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), size - n + 1)
        found = F.transform(starts, lambda at: F.array_join(F.slice(words, at, F.lit(n)), " "))
        return F.when(size > n, found).otherwise(F.array().cast("array<string>"))

    parts = [runs(n) for n in range(2, longest)]
    return F.concat(*parts)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT,
    kept_percent: int = KEPT_PERCENT, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to `longest` words of each language.

    Documents without words count nothing; repeated rows count each; an empty table
    gives no rows; ties go to the larger count, then the smaller phrase in byte
    order; other columns are left out.
    """
    if longest < 2:
        raise ValueError("phrases have two words or more")
    every = graph(docs, lang, text, longest, min_count)
    known = every.where(F.col("f") >= min_count)
    candidates = known.where(F.col("size") > 1)
    sized = lambda size: known.where(F.col("size") == size).select("lang", "gram", "f")
    unary, _ = compacted(sized(longest), sized(longest - 1))
    # an inner node of a path lies in an edge of the same weight
    open_ones = candidates.join(unary.withColumnRenamed("node", "gram"), ["lang", "gram"], "left_anti") if longest > 2 else candidates
    if longest > 2:
        holding = candidates.where(F.col("size") > 2).select("lang", F.col("f").alias("_held"), F.explode(_inner(F.col("gram"), F.col("size"), longest)).alias("gram"))
        holding = holding.groupBy("lang", "gram").agg(F.max("_held").alias("_held"))
        open_ones = open_ones.join(holding, ["lang", "gram"], "left").where(
            F.col("_held").isNull() | (F.col("_held") * 100 < F.col("f") * kept_percent)).drop("_held")

    side = lambda name, f: known.select("lang", F.col("gram").alias(name), F.col("f").alias(f))
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = open_ones.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), "size", cut)
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    exact = {c: f"cast({c} as {_EXACT})" for c in "alr"}
    score = F.expr(f"({exact['a']} * {exact['a']} * cast(1000000 as decimal(7,0))) div ({exact['l']} * {exact['r']})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    scored = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = every.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), s AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM s, (VALUES (1), (2), (3)) AS x(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10
), held AS (
  SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS longer
  FROM c, (VALUES (1), (2)) AS x(j) WHERE k = 3 GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase AND c.k = 2
  WHERE h.longer IS NULL OR 100 * h.longer < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, ws, k, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:], ' ') AS rp
  FROM kept, (VALUES (1), (2)) AS x(j) WHERE j < k
), scored AS (
  SELECT t.lang, t.phrase, t.a, t.j, x.f AS l, y.f AS r,
    CAST((1000000::HUGEINT * t.a * t.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts t JOIN g x ON x.lang = t.lang AND x.phrase = t.lp JOIN g y ON y.lang = t.lang AND y.phrase = t.rp
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score FROM ranked r JOIN n ON r.lang = n.lang WHERE r.rank <= 2000
"""
