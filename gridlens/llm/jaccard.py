"""N-gram Jaccard join by a token-group matrix.

Documents are sets of 5-word shingles; two link at 100 * intersection >= 75 * union.

1. Equal sets become one node.  Every node lists its rarest quarter of tokens
   (rarity by a count sketch of all tokens); linked nodes share one of them.
2. Nodes with a common minimum hash of listed tokens are compared with the first
   of them, and links are merged to classes, so that thousands of near copies
   become one class after a number of comparisons in proportion to the nodes.
3. Classes are cut into groups of similar nodes.  The matrix (listed token, group)
   gives each node the groups of other classes that can hold a partner.  Parity
   bitmaps of the sets, a few bytes each, bound the difference to the group's
   members, and the union of the group's tokens bounds the overlap; only groups
   that pass both are opened and their members compared.

Nodes of one class need no comparison, since only the class is asked for; every
other linked pair shares a listed token, so no link between classes is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import GAMMA, free, mix64, numbered, shingle_hashes, table, text_bytes, word_hashes, written

CELLS = 1 << 20
CHUNKS = 64
MINIMA = 8
GROUP = 64
PER_SALT = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that only a few sets at a time are copied out of Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokens_of(data: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(data)[0]))


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it links to."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def parity_bits(tokens: np.ndarray) -> bytes:
    """Bitmap of two bits or more per token in which every token flips one bit; its length is a power of two."""
    size = 64 << max(0, (2 * len(tokens) - 1).bit_length() - 6)
    flips = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """Whether sets of n and m tokens with these bitmaps can link: flipped bits that differ come from tokens that differ."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while len(a) != len(b):  # folding the longer bitmap gives that of the shorter length
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    apart = int(np.bitwise_count(a ^ b).sum())
    return apart * (100 + percent) <= (100 - percent) * (n + m)


def count_sketch(docs: DataFrame, text: str) -> np.ndarray:
    """Documents per cell of hashed tokens: CELLS numbers, whatever the size of the table."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int32)
        for batch in batches:
            for data in text_bytes(batch.column(0)):
                np.add.at(total, (tokens_of(data) % np.uint64(CELLS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, CHUNKS)], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, dtype=np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = docs.select(text).mapInArrow(counts, schema).repartition(CHUNKS, "chunk").mapInArrow(add, schema).collect()
    out = np.zeros((CHUNKS, CELLS // CHUNKS), dtype=np.int64)
    for row in parts:
        out[row["chunk"]] += np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel()


def described(docs: DataFrame, id_column: str, text: str, percent: int) -> DataFrame:
    """Stored rows (row, doc_id, text_hash, n, digest, bits, minima, listed); digest is null for empty sets."""
    sketch = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, text))
    kind = docs.schema[id_column].dataType.simpleString()
    salts = mix64(np.arange(1, MINIMA + 1, dtype=np.uint64) * GAMMA)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, digests, bits, minima, listed = [], [], [], [], []
                for data in text_bytes(batch.column("text")):
                    tokens = tokens_of(data)
                    n = len(tokens)
                    sizes.append(n)
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if n else None)
                    bits.append(parity_bits(tokens))
                    keep = n - least_overlap(n, percent) + 1 if n else 0
                    order = np.lexsort((tokens, cells[(tokens % np.uint64(CELLS)).astype(np.int64)]))[:keep]
                    listed.append(tokens[order].view(np.int64))
                    minima.append(np.array([mix64(tokens[order] ^ s).min() for s in salts], dtype=np.uint64).view(np.int64) if n else np.empty(0, np.int64))
                lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), lists(minima), lists(listed)],
                    ["doc_id", "text_hash", "n", "digest", "bits", "minima", "listed"],
                )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = rows.mapInArrow(describe, f"doc_id {kind}, text_hash long, n long, digest binary, bits binary, minima array<long>, listed array<long>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "described")


def node_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text: str, unique: bool) -> DataFrame:
    """Stored (node, tokens) of the wanted (node, doc_id, digest), from the texts of these ids; unique: no id repeats."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, sets = [], []
            for node, digest, data in zip(batch.column("node").to_pylist(), batch.column("digest").to_pylist(), text_bytes(batch.column("text"))):
                raw = tokens_of(data).tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == digest:
                    nodes.append(node)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    texts = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
    found = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "digest", "text")
    found = found.mapInArrow(collect, "node long, tokens binary")
    return written(found if unique else found.dropDuplicates(["node"]), "sets")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_set = lambda raw: np.frombuffer(raw, dtype=np.uint64)
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]
            kept = [(a, b) for a, b, x, y in zip(*columns) if linked(as_set(x), as_set(y), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and bitmaps allow to link; bits: (node, n, bits)."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bits = lambda raw: np.frombuffer(raw, dtype=np.uint64)
        for batch in pieces(batches):
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "na", "ba", "nb", "bb")]
            kept = [(a, b) for a, b, n, x, m, y in zip(*columns) if may_link(n, as_bits(x), m, as_bits(y), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    side = lambda at: bits.select(F.col("node").alias(at), F.col("n").alias(f"n{at}"), F.col("bits").alias(f"b{at}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ba", "nb", "bb").mapInArrow(test, "a long, b long")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (node, class) after links (a, b) between nodes: class is the least node that can be reached.

    Every class takes the least class among its neighbours, and chains are followed
    by jumping, until nothing changes.  Only classes with links take part.
    """
    named = lambda at: classes.select(F.col("node").alias(at), F.col("class").alias(f"c{at}"))
    edges = links.join(named("a"), "a").join(named("b"), "b").where("ca <> cb").select("ca", "cb")
    edges = written(edges.unionByName(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "edges")
    labels = written(edges.select(F.col("ca").alias("c")).distinct().withColumn("to", F.col("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("c").alias("cb"), F.col("to").alias("near")), "cb").groupBy("ca").agg(F.min("near").alias("near"))
        step = labels.join(near, F.col("c") == F.col("ca")).select("c", "to", F.least("to", "near").alias("next"))
        jump = step.select(F.col("c").alias("j"), F.col("next").alias("jumped"))
        after = written(step.join(jump, F.col("next") == F.col("j")).select("c", "to", F.least("next", "jumped").alias("next")), "labels")
        if not after.where("next <> to").take(1):
            break
        labels = after.select("c", F.col("next").alias("to"))
    found = classes.join(labels, F.col("class") == F.col("c"), "left")
    return written(found.select("node", F.coalesce("to", "class").alias("class")), "classes")


def grouped(members: DataFrame) -> DataFrame:
    """Stored (node, class, g) of members (node, class, near): groups of at most GROUP members of one class, near ones together.

    Members are dealt in ranges of (class, near, node), so a class of any size, also
    one with few distinct values of `near`, is spread over the tasks and cut in each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, filled, g = None, 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            groups = []
            for found in batch.column("class").to_pylist():
                if found != current or filled == GROUP:
                    current, filled, g = found, 0, g + 1
                filled += 1
                groups.append(g)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("class"), pa.array(groups, pa.int64())], ["node", "class", "g"])

    order = ["class", "near", "node"]
    dealt = members.select("node", "class", "near").repartitionByRange(*order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(cut, "node long, class long, g long"), "groups")


def by_group(queries: DataFrame, groups: DataFrame, payload: DataFrame) -> DataFrame:
    """Rows (g, salt, kind, node, payload...) dealt by group and sorted: the members (b, g) of a group, then its queries (a, g).

    A group with many queries is dealt out by salts, with its at most GROUP members in front of each part.
    """
    columns = [c for c in payload.columns if c != "node"]
    salts = written(queries.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts")), "salts")
    asked = queries.join(salts, "g").join(payload.withColumnRenamed("node", "a"), "a")
    asked = asked.select("g", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("a").alias("node"), *columns)
    members = groups.join(salts, "g").join(payload.withColumnRenamed("node", "b"), "b")
    members = members.select("g", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("node"), *columns)
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data, much work: not to be coalesced
    return members.unionByName(asked).repartition(parts, "g", "salt").sortWithinPartitions("g", "salt", "kind")


def possible_groups(queries: DataFrame, groups: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Stored queries (a, g) whose group has a member that size and bitmap allow to link; no token is moved."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, []
        for batch in pieces(batches):
            kept = []
            for g, kind, node, n, raw in zip(*[batch.column(c).to_pylist() for c in ("g", "kind", "node", "n", "bits")]):
                if g != current:
                    current, members = g, []
                own = np.frombuffer(raw, dtype=np.uint64)
                if kind == 0:
                    members.append((n, own))
                elif any(may_link(n, own, m, other, percent) for m, other in members):
                    kept.append((node, g))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "g"])

    return written(by_group(queries, groups, bits).mapInArrow(test, "a long, g long"), "possible")


def group_links(queries: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes `a` of queries (a, g) and members `b` of groups (b, g).

    The union of a group's tokens bounds the overlap, and only queries that can
    reach the threshold open it.
    """

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, union = None, [], None
        for batch in pieces(batches):
            links = []
            for g, kind, node, raw in zip(*[batch.column(c).to_pylist() for c in ("g", "kind", "node", "tokens")]):
                if g != current:
                    current, members, union = g, [], None
                tokens = np.frombuffer(raw, dtype=np.uint64)
                if kind == 0:
                    members.append((node, tokens))
                    union = None
                    continue
                if union is None:
                    union = np.unique(np.concatenate([t for _, t in members]))
                at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
                if int((union[at] == tokens).sum()) < least_overlap(len(tokens), percent):
                    continue
                # the members are of one class: one link tells all
                partner = next((other for other, t in members if linked(tokens, t, percent)), None)
                if partner is not None:
                    links.append((node, partner))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return by_group(queries, groups, sets).mapInArrow(open_groups, "a long, b long")


def classes_of(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Stored rows of `described` and stored (digest, node, class) of their distinct sets."""
    rows = described(docs, id_column, text, percent)
    spark = docs.sparkSession
    free(spark)
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes, "nodes")
    unique = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    # the rows but the first of equal sets are few as a rule, and have no lists to move
    repeated = rows.select("digest", "row").join(nodes.where("copies > 1"), "digest").where("row <> node").select("row")
    firsts = rows.where("digest is not null").join(written(repeated, "repeated"), "row", "left_anti").withColumnRenamed("row", "node")
    chosen = written(firsts.select("node", "doc_id", "digest", "n", "bits", "minima"), "chosen")
    bits = chosen.select("node", "n", "bits")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return node_sets(docs, chosen.select("node", "doc_id", "digest").join(wanted.distinct(), "node"), id_column, text, unique)

    def links_of(pairs: DataFrame) -> DataFrame:
        allowed = written(possible(pairs, bits, percent), "allowed")
        sets = sets_of(allowed.select(F.explode(F.array("a", "b")).alias("node")))
        return written(compared(allowed, sets, percent), "links")

    # nodes with a common minimum hash: the first of them is compared with the others
    minima = chosen.select("node", F.posexplode("minima").alias("k", "hash"))
    heads = written(minima.groupBy("k", "hash").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "heads")
    pairs = written(minima.join(heads, ["k", "hash"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    classes = merged(chosen.select("node", F.col("node").alias("class")), links_of(pairs))

    # listed tokens that stand in two nodes or more: first and last are combined before the shuffle
    tokens = firsts.select("node", F.col("n").cast("int").alias("n"), F.posexplode("listed").alias("at", "token"))
    shared = written(tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("token"), "tokens")
    free(spark)
    listed = written(tokens.join(shared, "token"), "listed")
    free(spark)

    while True:
        named = listed.join(classes, "node")
        wide = named.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min_by("node", "class").alias("b"), F.count(F.lit(1)).alias("n"))
        wide = written(wide.where("low <> high").select("token", "low", "b", "n"), "wide")
        crossing = written(named.join(wide.select("token"), "token"), "crossing")
        size = wide.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("squares")).first()
        if not size["rows"] or size["squares"] <= 64 * size["rows"]:
            break
        # many nodes of different classes share tokens: one more comparison with the first class of each token
        again = crossing.join(wide, "token").where("class <> low").select(F.col("node").alias("a"), "b").distinct()
        again = written(again.join(pairs, ["a", "b"], "left_anti"), "pairs")
        found = links_of(again)
        classes = merged(classes, found)
        if found.count() * 100 < size["rows"]:  # little is left to merge
            named = listed.join(classes, "node")
            crossing = written(named.join(wide.select("token"), "token"), "crossing")
            break
        pairs = pairs.unionByName(again)

    # groups: members of a class, similar ones (by their first minimum) next to each other
    members = crossing.select("node", "class").distinct().join(chosen.select("node", F.element_at("minima", 1).alias("near")), "node")
    members = grouped(members)
    placed = crossing.select("token", "node", "n", "at").join(members, "node")
    matrix = placed.groupBy("token", "class", "g").agg(F.max(F.col("n") - F.col("at")).alias("room"), F.min("n").alias("least"), F.max("n").alias("most"))
    # the first listed token that a linked pair shares leaves room in both for the overlap that their sizes ask for
    asked = crossing.alias("q").join(matrix.alias("m"), "token").where("q.class > m.class")
    overlap = (F.col("q.n") + F.col("least")) * percent
    fits = (F.col("least") * percent <= F.col("q.n") * 100) & (F.col("q.n") * percent <= F.col("most") * 100)
    fits = fits & ((F.col("q.n") - F.col("at")) * (100 + percent) >= overlap) & (F.col("room") * (100 + percent) >= overlap)
    queries = asked.where(fits).select(F.col("q.node").alias("a"), F.col("m.g").alias("g")).distinct()
    groups = members.select(F.col("node").alias("b"), "g")
    queries = possible_groups(written(queries, "queries"), groups, bits, percent)
    groups = groups.join(queries.select("g").distinct(), "g")
    sets = sets_of(queries.select(F.col("a").alias("node")).unionByName(groups.select(F.col("b").alias("node"))))
    classes = merged(classes, written(group_links(queries, groups, sets, percent), "links"))
    return rows, written(nodes.join(classes, "node"), "members")


def components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: doc_id, text_hash, row, n_shingles, component (of rows), component_id (its least doc_id).

    Null, empty and blank texts have empty sets and are components of their own;
    repeated rows and equal sets are linked; rows with a null id take part, and a
    component whose ids are all null has a null id.  An empty table gives none.
    """
    rows, members = classes_of(docs, id_column, text, percent)
    found = rows.select("row", "doc_id", "text_hash", "n", "digest").join(members.select("digest", "class"), "digest", "left")
    found = written(found.select("row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("class", "row").alias("component")), "components")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    least = written(least, "least").select(F.col("component").alias("_c"), "component_id", "copies")
    found = found.join(least, F.col("component") == F.col("_c"), "left")
    return found.withColumn("component_id", F.when(F.col("_c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))).drop("_c", "copies")


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of each component with all its columns, whatever their names: that with the least id (a null id last).

    Of equal ids and texts on several rows any one stays; empty and blank texts all
    stay; an empty table gives none.
    """
    columns = docs.columns
    docs, _, (id_column, text) = numbered(docs, id_column, text)
    found = written(components(docs, id_column, text, percent), "found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("i"), F.col("row").alias("r"))).alias("first")
    kept = found.join(found.groupBy("component").agg(first).select(F.col("first.r").alias("row")), "row").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    # an id (or none) and text that stand on more than one row of a component: one of these rows is kept; blank texts all are
    again = found.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(F.col("doc_id").alias("_ai"), F.col("text_hash").alias("_ah")), "again")
    repeated = F.col("_i").eqNullSafe(F.col("_ai")) & (F.col("_h") == F.col("_ah"))
    once = written(kept.join(again, repeated, "left_anti"), "kept")
    several = written(kept.join(again, repeated, "left_semi"), "kept")
    free(docs.sparkSession)
    chosen = F.col(id_column).eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_h"))
    out = docs.join(once, chosen, "left_semi")
    out = out.unionByName(docs.join(several, chosen, "left_semi").dropDuplicates([id_column, text])) if several.take(1) else out
    return out.toDF(*columns)


def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    found = components(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")
