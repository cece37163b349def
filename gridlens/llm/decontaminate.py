"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Windows of every item length slide over the text by single words, so the order of an
item's parts does not matter.  A window that is similar enough holds a least number of
shingles that stand in items of its length; every start with so many is fingerprinted,
and the others cannot pass the exact check.  Each window and item gets a 64-bit SimHash
of its shingles, weighted by their number.  The hash is cut into 16 blocks of 4 bits;
items are listed under every block value that differs in at most one bit, so every pair
within distance 31 meets in a block.  Pairs within RADIUS are checked by the weighted
Jaccard similarity of their shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import numbered, table, written

SHINGLE = 5
BLOCKS, BITS = 16, 4
RADIUS = 26
BROADCAST_CELLS = 500_000
SPACE = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-case words ([^\\x20\\x09-\\x0D]+) of a text; none for null."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(words: Column, k: int) -> Column:
    """Hash of each run of k words."""
    run = lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])
    short = F.array().cast("array<long>")
    return F.when(F.size(words) < k, short).otherwise(F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(0))), run))


def simhash(hashes: Column) -> Column:
    """64 bits: each the majority of that bit over the hashes, repeated ones counted as often."""
    zero = F.lit(0).cast("long")
    bits = F.sequence(F.lit(0), F.lit(63))
    bit = lambda h, b: F.call_function("shiftrightunsigned", h, b).bitwiseAND(1)

    def with_bit(total: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, zero, lambda n, h: n + bit(h, b))
        return total.bitwiseOR(F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(zero))

    return F.aggregate(bits, zero, with_bit)


def _block(value: Column, k: int) -> Column:
    return F.shiftrightunsigned(value, k * BITS).bitwiseAND((1 << BITS) - 1).cast("int")


def similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """Weighted overlap and total of two sorted lists of hashes: sums of the lesser and the greater counts.

    Hashes that stand once are met by an intersection of the lists; only those that
    repeat in both are counted one by one.
    """
    repeated = lambda x: F.filter(x, lambda h, i: (i > 0) & (F.get(x, i - 1) == h))
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    both = F.array_intersect(repeated(a), repeated(b))
    common = F.aggregate(both, F.size(F.array_intersect(a, b)), lambda n, h: n + F.least(count(a, h), count(b, h)) - 1)
    return common, F.size(a) + F.size(b) - common


def benchmark_items(benchmark: DataFrame, id_column: str, text: str) -> DataFrame:
    """Stored distinct items with words: item (own key, never null), item_id, length, k (words per shingle), sorted hashes, fingerprint."""
    items = benchmark.select(F.col(id_column).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0).distinct()
    k = F.least(F.size("w"), F.lit(SHINGLE))
    hashes = shingles(F.col("w"), SHINGLE)
    for short in range(1, SHINGLE):
        hashes = F.when(F.size("w") == short, shingles(F.col("w"), short)).otherwise(hashes)
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("w").alias("length"), k.alias("k"), F.array_sort(hashes).alias("hashes"))
    return written(items.withColumn("fingerprint", simhash(F.col("hashes"))), "items")


def starts(at: Column, n: Column, length: Column, percent: int) -> Column:
    """Starts of all windows of `length` words in a text of n that can be similar enough to an item of that length.

    `at`: ascending places of the text's shingles that stand in items of the length.
    A window and an item share at most as many shingles, repeated ones counted, as
    the window has such places, and the threshold asks for `need` shared ones.  So
    `need` places in a row allow the starts from which all of them are inside.
    """
    k = F.least(length, F.lit(SHINGLE))
    own = F.least(length, n) - k + 1
    wanted = (length - k + 1 + own) * percent + (100 + percent - 1)
    need = F.greatest(F.lit(1), ((wanted - F.pmod(wanted, F.lit(100 + percent))) / (100 + percent)).cast("int"))
    none = F.array().cast("array<int>")

    def around(i: Column) -> Column:
        low, high = F.greatest(F.lit(0), F.get(at, i + need - 1) - (own - 1)), F.least(F.get(at, i), F.greatest(F.lit(0), n - length))
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    return F.when(F.size(at) < need, none).otherwise(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), around))))


def small(df: DataFrame) -> DataFrame:
    """A stored table of numbers and arrays of numbers: broadcast if rows and array elements are few, else left to a shuffled join."""
    cells = sum((F.size(c) for c, kind in df.dtypes if kind.startswith("array")), F.lit(1))
    return F.broadcast(df) if (df.agg(F.sum(cells)).first()[0] or 0) <= BROADCAST_CELLS else df


def leaks(
    docs: DataFrame, benchmark: DataFrame, percent: int = 75, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Stored (key_1, key_2, item_id, similarity, word_start): texts, by their two hashes, that hold an item.

    Copies of a text count once.  Items of fewer than five words are one shingle of
    all their words.  Null and empty texts and items match nothing; of several
    windows for an item the most similar, then the first is given.  Items with one id
    count as one item; those with a null id are items of their own, told apart by
    their words, and are reported with a null item_id.
    """
    items = benchmark_items(benchmark, item_id, item_text)
    keyed = docs.select(F.xxhash64(text).alias("key_1"), F.xxhash64(F.col(text), F.lit(1)).alias("key_2"), F.col(text).alias("_text"))

    grams = items.select("k", "length", F.explode("hashes").alias("hash")).distinct()
    grams = small(written(grams, "grams"))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # five values at most
    hits = None
    for k in sizes:
        words = keyed.select("key_1", "key_2", words_of(F.col("_text")).alias("w"))
        runs = words.select("key_1", "key_2", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), k)).alias("at", "hash"))
        found = runs.join(grams.where(F.col("k") == k), "hash")
        found = found.select("key_1", "key_2", "n", "length", "at")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        empty = "key_1 long, key_2 long, item_id " + benchmark.schema[item_id].dataType.simpleString() + ", similarity double, word_start int"
        return docs.sparkSession.createDataFrame([], empty)
    places = hits.distinct().groupBy("key_1", "key_2", "n", "length").agg(F.sort_array(F.collect_list("at")).alias("at"))
    places = places.select("key_1", "key_2", F.struct("length", starts(F.col("at"), F.col("n"), F.col("length"), percent).alias("starts")).alias("place"))
    places = places.where(F.size("place.starts") > 0).groupBy("key_1", "key_2").agg(F.collect_list("place").alias("places"))
    places = written(places, "places")

    texts = keyed.join(places, ["key_1", "key_2"]).groupBy("key_1", "key_2").agg(F.any_value("_text").alias("_text"), F.any_value("places").alias("places"))
    windows = texts.select("key_1", "key_2", words_of(F.col("_text")).alias("w"), "places")
    windows = windows.select("key_1", "key_2", "w", shingles(F.col("w"), SHINGLE).alias("s"), F.explode("places").alias("place"))
    windows = windows.select("key_1", "key_2", "w", "s", F.explode(F.transform("place.starts", lambda x: F.struct(x.alias("start"), F.col("place.length").alias("length")))).alias("p"))
    hashes = F.slice("s", F.col("p.start") + 1, F.greatest(F.least(F.col("p.length"), F.size("w")) - (SHINGLE - 1), F.lit(0)))
    for k in sizes:
        if k < SHINGLE:
            run = F.xxhash64(*[F.get("w", F.col("p.start") + j) for j in range(k)])
            hashes = F.when(F.col("p.length") == k, F.array(run)).otherwise(hashes)
    windows = windows.select("key_1", "key_2", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.array_sort(hashes).alias("window"))
    windows = written(windows.withColumn("mark", simhash(F.col("window"))), "windows")

    flips = [0] + [1 << b for b in range(BITS)]
    listed = items.select(
        "item", "length", "fingerprint", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("fingerprint"), k).bitwiseXOR(f).alias("v")) for k in range(BLOCKS) for f in flips])).alias("block")
    )
    listed = small(written(listed.select("item", "length", "fingerprint", "block.k", "block.v"), "blocks"))
    probes = windows.select("key_1", "key_2", "start", "length", "mark", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _block(F.col("mark"), k).alias("v")) for k in range(BLOCKS)])).alias("block"))
    probes = probes.select("key_1", "key_2", "start", "length", "mark", "block.k", "block.v")
    near = probes.join(listed, ["length", "k", "v"]).where(F.bit_count(F.col("mark").bitwiseXOR(F.col("fingerprint"))) <= RADIUS)
    near = near.select("key_1", "key_2", "start", "length", "item").distinct()
    near = near.join(windows, ["key_1", "key_2", "start", "length"]).join(small(items.select("item", "hashes")), "item")
    common, total = similarity(F.col("window"), F.col("hashes"))
    near = near.withColumn("common", common).withColumn("total", F.size("window") + F.size("hashes") - F.col("common"))
    near = near.where(F.col("common") * 100 >= F.col("total") * percent)
    best = F.min(F.struct((-F.col("common") / F.col("total")).alias("s"), F.col("start").alias("at"))).alias("best")
    named = near.join(items.select("item", "item_id"), "item").withColumn("_unnamed", F.when(F.col("item_id").isNull(), F.col("item")))
    out = named.groupBy("key_1", "key_2", "item_id", "_unnamed").agg(best)
    return written(out.select("key_1", "key_2", "item_id", (-F.col("best.s")).alias("similarity"), F.col("best.at").alias("word_start")), "leaks")


def _same_text(text: str) -> Column:
    return (F.xxhash64(text) == F.col("key_1")) & (F.xxhash64(F.col(text), F.lit(1)) == F.col("key_2"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """A row per document and item it holds: the document's columns, item_id, similarity, word_start (these names are replaced).

    Repeated rows are reported each; other columns, whatever their names, are kept; an
    empty table gives none.
    """
    plain, names, (at,) = numbered(docs, text)
    own = [(n, c) for n, c in zip(names, docs.columns) if c.lower() not in ("item_id", "similarity", "word_start")]
    found = plain.join(leaks(plain, benchmark, text=at, **options), _same_text(at))
    return found.select(*[F.col(n).alias(c) for n, c in own], "item_id", "similarity", "word_start")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with their columns, whatever their names; repeated rows stay."""
    plain, _, (at,) = numbered(docs, text)
    found = leaks(plain, benchmark, text=at, **options).select("key_1", "key_2").distinct()
    return plain.join(found, _same_text(at), "left_anti").toDF(*docs.columns)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, folder, "benchmark")).select("doc_id", "item_id", "similarity", "word_start")
