"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, at line breaks and sentence ends; each distinct
paragraph digest is put into one cell of each of three sub-tables, where a cell
keeps the number, the XOR of the digests and the XOR of their check values.
Subtracting the sketches of two versions leaves the paragraphs in which they
differ; peeling recovers them: a cell with one digest that passes its check gives
it away, and removing it from its other cells may free the next.  Where that does
not empty the sketch, a larger one is tried.
Everything is DataFrame work: cells are rows, a peeling step is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import free, table, written

TABLES = 3
BASE = 8  # cells of a sub-table in the printed fingerprint
ROOM = 0.6  # cells of a sub-table per digest of the two versions, at the first attempt
STEPS = 15  # peeling steps of one attempt, over the sub-tables in turn
SENTENCE = r"\n+|(?<=[.!?]) +"


def paragraph_digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of the paragraphs of a text; blank ones are left out."""
    parts = F.filter(F.split(text, SENTENCE), lambda p: p != "")
    return F.sort_array(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _cell(digest: Column, sub: int | Column, size: Column | int) -> Column:
    """Cell of a digest in a sub-table; other sizes place it anew."""
    return F.pmod(F.xxhash64(digest, F.lit(sub) if isinstance(sub, int) else sub, F.lit(size) if isinstance(size, int) else size), size)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(77)).bitwiseAND(0xFFFFFFFF)


def fingerprint(digests: Column) -> Column:
    """The sketch with BASE cells per sub-table as text: number, digests and checks of each cell in hexadecimal."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))
    add = lambda a, x: F.struct((a["n"] + 1).alias("n"), a["d"].bitwiseXOR(x).alias("d"), a["c"].bitwiseXOR(_check(x)).alias("c"))

    def sub_table(sub: int) -> Column:
        placed = F.transform(digests, lambda x: F.struct(x.alias("x"), _cell(x, sub, BASE).alias("at")))
        inside = lambda at: F.filter(placed, lambda y: y["at"] == at)
        shown = lambda a: F.concat_ws(".", F.hex(a["n"]), F.hex(a["d"]), F.hex(a["c"]))
        return F.transform(F.sequence(F.lit(0), F.lit(BASE - 1)), lambda at: F.aggregate(inside(at), zero, lambda a, y: add(a, y["x"]), shown))

    return F.array_join(F.concat(*[sub_table(t) for t in range(TABLES)]), "-")


def _position(value: Column, cuts: list) -> Column:
    """How many of the descending cuts are at least the value; looks at every g-th cut first."""
    step = max(1, int(len(cuts) ** 0.5))
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    at_least = lambda values: F.size(F.filter(values, lambda c: value <= c))
    coarse = at_least(literal(cuts[step - 1 :: step]))
    groups = [cuts[k : k + step] for k in range(0, len(cuts) + 1, step)]
    fine = F.element_at(F.array(*[literal(g) if g else F.slice(literal(cuts[:1]), 1, 0) for g in groups]), coarse + 1)
    return coarse * step + at_least(fine)


def with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in descending order of the id, each with `next_text`, the text of the following one (after the last: of the first); null texts come back empty.

    The table is cut into ranges of ids; the first row of each range stands at the
    end of the range before as well, so that one shuffle suffices and no task sees
    more than a range.  The number of ranges grows as the root of the rows.  Rows with
    equal ids follow each other in the order of their texts.  Null ids come last.
    """
    # one text per row is moved
    rows = docs.select(*[c for c in docs.columns if c != text], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = 1 + int(docs.count() ** 0.5 / 20)
    cuts = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        cuts = sorted(set(docs.agg(F.percentile_approx(id_column, shares, 10_000).alias("c")).first()["c"] or []), reverse=True)
    # range 0 has the largest ids; nulls stand below all others
    below = _position(F.col(id_column), cuts) if cuts else F.lit(0)
    rows = rows.withColumn("_range", F.when(F.col(id_column).isNull(), F.lit(len(cuts) + 1)).otherwise(below))
    order = F.struct(F.col(id_column).isNotNull().alias("a"), F.col(id_column).alias("b"), F.xxhash64("_text").alias("c"))
    heads = {r["_range"]: r["head"] for r in rows.groupBy("_range").agg(F.max(order).alias("head")).collect()}
    known = sorted(heads)
    before = {k: known[(i - 1) % len(known)] for i, k in enumerate(known)}
    kind = docs.schema[id_column].dataType
    by_range = lambda value, kind: F.element_at(F.array(*[F.lit(value(k) if k in heads else None).cast(kind) for k in range(len(cuts) + 2)]), F.col("_range") + 1)
    is_head = F.col(id_column).eqNullSafe(by_range(lambda k: heads[k]["b"], kind)) & (F.xxhash64("_text") == by_range(lambda k: heads[k]["c"], "long"))
    stand = lambda at, ghost: F.struct(at.alias("r"), F.lit(ghost).alias("g"))
    here, there = stand(F.col("_range"), False), stand(by_range(lambda k: before[k], "int"), True)
    copies = F.when(is_head, F.array(here, there)).otherwise(F.array(here))
    placed = rows.withColumn("_in", F.explode(copies))
    following = Window.partitionBy(F.col("_in.r")).orderBy(
        F.col("_in.g"), F.col(id_column).desc_nulls_last(), F.xxhash64("_text").desc()
    )
    placed = placed.withColumn("next_text", F.lead("_text").over(following)).withColumn("_ghost", F.col("_in.g"))
    return placed.where(~F.col("_ghost")).select(*[F.col("_text").alias(c) if c == text else c for c in docs.columns], "next_text")


def edited_text(text: Column, other: Column) -> Column:
    """The text whose last floor(n/2) code points are replaced by as many first ones of the other (or all it has)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def _peeled(pairs: DataFrame) -> DataFrame:
    """One attempt for pairs (pair, a, b, size): `left` cells that stay filled and `found` digests.

    A step peels one sub-table, where every digest has one cell only, so none is
    removed twice.  Pairs without any difference have no row.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    cell = lambda t, at, n, d, c, f: F.struct(t.alias("t"), at.alias("at"), n.alias("n"), d.alias("d"), c.alias("c"), f.alias("f"))
    size = F.col("size")

    def everywhere(x: Column, sign: Column, subs: list[int]) -> list[Column]:
        return [cell(F.lit(t), _cell(x, t, size), sign, x, _check(x), none) for t in subs]

    account = lambda f: cell(F.lit(-1), none, none, none, none, f)  # noqa: E731  keeps the count, and pairs without paragraphs
    every = list(range(TABLES))
    signed = lambda name, sign: F.transform(name, lambda x: F.struct(x.alias("x"), F.lit(sign).cast("long").alias("s")))
    rows = pairs.repartition("pair").select("pair", "size", F.explode_outer(F.concat(signed("a", 1), signed("b", -1))).alias("e"))
    placed = F.when(F.col("e").isNull(), F.array(account(none))).otherwise(F.array(*everywhere(F.col("e.x"), F.col("e.s"), every)))
    cells = rows.select("pair", "size", F.explode(placed).alias("v")).select("pair", "size", "v.*")

    def summed(cells: DataFrame) -> DataFrame:
        sums = cells.groupBy("pair", "size", "t", "at").agg(F.sum("n").alias("n"), F.expr("bit_xor(d)").alias("d"), F.expr("bit_xor(c)").alias("c"), F.sum("f").alias("f"))
        return sums.where("t = -1 or n <> 0 or d <> 0 or c <> 0")

    # versions without a difference leave no cell at all
    cells = summed(cells)
    for step in range(STEPS):
        sub = step % TABLES
        pure = (F.col("t") == sub) & (F.abs("n") == 1) & (_check(F.col("d")) == F.col("c")) & (_cell(F.col("d"), sub, size) == F.col("at"))
        removed = F.array(account(one), *everywhere(F.col("d"), -F.col("n"), [t for t in every if t != sub]))
        kept = F.array(cell(*[F.col(c) for c in ("t", "at", "n", "d", "c", "f")]))
        cells = cells.select("pair", "size", F.explode(F.when(pure, removed).otherwise(kept)).alias("v")).select("pair", "size", "v.*")
        cells = summed(cells)
    return cells.groupBy("pair").agg(F.count_if(F.col("t") >= 0).alias("left"), F.sum("f").alias("found"))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, a, b) -> (pair, n_a, n_b, differing): how many paragraph digests stand in one array only, by subtract and peel.

    Pairs whose sketch does not empty are tried again with twice the cells, placed
    anew, until all are resolved; `pair` must be unique, arrays are sets.
    """
    n = F.size("a") + F.size("b")
    todo = pairs.withColumn("size", F.greatest(F.ceil(n * ROOM).cast("int"), F.lit(4)))
    done = None
    while True:
        tried = written(_peeled(todo), "peeled")
        free(pairs.sparkSession)
        solved = tried.where("left = 0").select("pair", F.col("found").alias("differing"))
        done = solved if done is None else done.unionByName(solved)
        failed = tried.where("left > 0").select("pair")
        if not failed.take(1):
            break
        todo = todo.join(failed, "pair").withColumn("size", F.col("size") * 2)
    sizes = pairs.select("pair", F.size("a").alias("n_a"), F.size("b").alias("n_b"))
    return sizes.join(done, "pair", "left").fillna(0, ["differing"])


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Shared share of all distinct paragraphs; 1 if neither text has any."""
    both = n_a + n_b
    return F.when(both == 0, F.lit(1.0)).otherwise((both - differing) / (both + differing))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, edited_sha256, both fingerprints, near_edited and near_next.

    A null text is empty; equal texts have equal fingerprints, as a fingerprint is a
    function of the paragraphs.  Repeated rows each give a row; an empty table gives
    none; other columns are left out.
    """
    rows = with_next(docs.select(id_column, F.col(text).alias("text")), id_column, "text")
    rows = rows.withColumn("_edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("_edited")).alias("edited"),
        paragraph_digests(F.col("next_text")).alias("following"),
    )
    rows = written(rows, "paragraphs")
    free(docs.sparkSession)
    versions = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("b")) for k, c in enumerate(("edited", "following"))]))
    pairs = rows.select("row", F.col("own").alias("a"), versions.alias("v"))
    pairs = pairs.select((F.col("row") * 2 + F.col("v.k")).alias("pair"), "a", F.col("v.b").alias("b"))
    near = differences(pairs)
    near = near.select(F.floor(F.col("pair") / 2).alias("row"), F.pmod("pair", F.lit(2)).alias("k"), likeness(F.col("n_a"), F.col("n_b"), F.col("differing")).alias("near"))
    near = near.groupBy("row").agg(F.max(F.when(F.col("k") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("k") == 1, F.col("near"))).alias("near_next"))
    return rows.join(near, "row").select(
        id_column,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
