"""Ordinals, exact quantiles and joins to small tables, without hot tasks.

A window over a whole table or over one large group runs in one task.  The
helpers here cut the order into buckets first, number each bucket on its own
and add the (small) bucket offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridlens.functions.columns import quoted, row_hash
from gridlens.session import materialise

SAMPLED_PER_BUCKET = 20


def lookup_join(df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of a table that is usually small; NULL keys match NULL.

    The table is written once, so the size of its files is known when the join is
    planned: under Spark's own limit it is sent to every task, beyond it both sides
    are dealt by key, and adaptive execution splits the rows of a hot key.
    """
    renamed = materialise(
        small.select(
            *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            *[quoted(c) for c in small.columns if c not in keys],
        ),
        "lookup",
    )
    same = [quoted(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    added = [quoted(c) for c in small.columns if c not in keys and how != "left_semi"]
    return df.join(renamed, reduce(lambda a, b: a & b, same), how).select(
        *[quoted(c) for c in df.columns], *added
    )


def split_points(df: DataFrame, column: str, buckets: int = 256) -> list:
    """Ascending cut values that spread a column over buckets, NULL first; a
    value that holds more rows than a bucket occurs more than once.

    They come from rows drawn at random, each with equal chance, and only balance
    the work: results never depend on them.
    """
    chosen = (
        df.select(quoted(column).alias("v"), F.rand(1).alias("h"))
        .orderBy("h")
        .limit(buckets * SAMPLED_PER_BUCKET)
    )
    found = [r["v"] for r in chosen.select("v").collect() if r["v"] == r["v"]]
    values = sorted(found, key=lambda v: (v is not None, v))
    return [values[i * len(values) // buckets] for i in range(1, buckets)] if values else []


def distinct_points(cuts: Sequence) -> list:
    return sorted({c for c in cuts if c is not None})


def bucket_of(value: Column, points: Sequence[float]) -> Column:
    """Number of cut values that are <= value, by binary search; 0 for NULL."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(points[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(value.isNull(), F.lit(0)).otherwise(search(0, len(points)))


def bucketed_row_number(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Row number (from 1) within ``by`` in the given order.

    ``bucket`` must never decrease along ``order``.  Work is spread over
    (by, bucket) and not over ``by`` alone, so a key that holds a third of all
    rows is split as well.
    """
    keys = [*by, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        tagged.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], "_offset")
    )
    numbered = tagged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)],
    )
    return numbered.join(offsets, same).select(
        *df.columns, (F.col("_rn") + F.col("_offset")).cast("long").alias(name)
    )


def with_ordinal(
    df: DataFrame, order_by: str, ties: Sequence[str] = (), name: str = "position", parts: int | None = None
) -> DataFrame:
    """Row number (from 1) over the whole table, ordered by a column and its ties.

    Rows are dealt into ranges of (value, ties, place in the input), so rows that are
    equal in all columns are cut as well, and sorted in their range.  The written
    rows know their range and their place in it; a row number is that place plus the
    rows of earlier ranges.  Without ties equal values are ordered by the row's hash.
    """
    keyed = df.withColumn("_input", F.monotonically_increasing_id())
    if not ties:
        keyed, ties = keyed.withColumn("_hash", row_hash(df)), ["_hash"]
    order = [quoted(order_by).asc_nulls_first(), *[quoted(c).asc_nulls_first() for c in ties], F.col("_input").asc()]
    ranged = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).select(*[quoted(c) for c in df.columns], F.monotonically_increasing_id().alias("_place"))
    stored = materialise(placed, "ordinal")
    bits = 33  # of the id, below the number of the range
    part = F.shiftright("_place", bits)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    offsets = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = stored.join(F.broadcast(offsets), part == F.col("_part"))
    position = F.col("_place").bitwiseAND(F.lit((1 << bits) - 1)) + F.col("_before") + 1
    return numbered.select(*[quoted(c) for c in df.columns], position.cast("long").alias(name))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows in an order; one bounded heap per task."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First k rows of each group.

    The filter on ``row_number`` lets Spark cut each group to k rows before
    the shuffle, so a hot group costs k rows per map task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


# ---------------------------------------------------------------- quantiles

LEADING_BITS = 13  # of the 64 of a number, counted in one scan of the whole table
GATHERED = 50_000  # values that are fetched instead of being counted by further bits
GROUP_BITS = (20, 22, 22)


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers in the order of the numbers (-0.0 is 0.0)."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def number_of(bits: np.ndarray) -> np.ndarray:
    """The numbers that :func:`ordered_bits` came from."""
    back = (bits ^ np.uint64(1 << 63)).view(np.int64)
    return (back ^ ((back >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, as rows
    (by..., column, n, q0, q1, ...); a column without values has none.  Without `by`,
    the column `rows` may say how many rows each stands for.

    Selection by radix: numbers become integers in the same order, and their
    leading bits are counted for all columns at once.  Only the bins that hold a
    wanted rank are counted by their next bits, until few enough values are left
    to be fetched, or no bit is left.  Values are neither sorted nor shuffled, and
    a value that fills the table is as cheap as any other.
    """
    if not columns:
        raise ValueError("no columns given")
    if by:
        if rows:
            raise ValueError("rows that stand for others are not counted in groups")
        parts = [_group_quantiles(df, c, probs, list(by)) for c in columns]
        return reduce(lambda a, b: a.unionByName(b), parts)
    counted = [quoted(rows).cast("long").alias("n")] if rows else []
    work = df.select(*[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)], *counted)
    found = _selected(work, len(columns), probs)
    out = []
    for c, (n, values) in sorted(found.items()):
        spots = [(n - 1) * float(p) for p in probs]
        ends = [(values[math.floor(x)], values[math.ceil(x)], x - math.floor(x)) for x in spots]
        out.append((columns[c], n, *[low if low == high else low + share * (high - low) for low, high, share in ends]))
    kinds = ", ".join(f"q{j} double" for j in range(len(probs)))
    return df.sparkSession.createDataFrame(out, f"column string, n long, {kinds}")


def _column_bits(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The values that are not missing, and how many rows each stands for (none: one)."""
    values = batch.column(f"v{i}").to_numpy(zero_copy_only=False)
    known = ~np.isnan(values)
    n = batch.column("n").to_numpy()[known] if "n" in batch.schema.names else None
    return ordered_bits(values[known]), n


def _bin_counts(work: DataFrame, prefixes: dict[int, np.ndarray], used: int, width: int) -> DataFrame:
    """(c, prefix, bin, n): values by their next `width` bits, among those whose first `used` bits are a wanted prefix."""
    mask = np.uint64((1 << width) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {c: np.zeros(len(p) << width, dtype=np.int64) for c, p in prefixes.items()}
        for batch in batches:
            for c, wanted in prefixes.items():
                bits, n = _column_bits(batch, c)
                place = np.zeros(len(bits), dtype=np.int64)
                if used:
                    own = bits >> np.uint64(64 - used)
                    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    inside = wanted[place] == own
                    bits, place, n = bits[inside], place[inside], None if n is None else n[inside]
                bins = ((bits >> np.uint64(64 - used - width)) & mask).astype(np.int64)
                totals[c] += np.bincount((place << width) + bins, n, minlength=len(totals[c])).astype(np.int64)
        for c, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), c, dtype=np.int32)), pa.array(prefixes[c][at >> width].view(np.int64)),
                 pa.array((at & ((1 << width) - 1)).astype(np.int32)), pa.array(total[at])],
                ["c", "prefix", "bin", "n"],
            )

    counted = work.mapInArrow(count, "c int, prefix long, bin int, n long")
    return counted.groupBy("c", "prefix", "bin").agg(F.sum("n").alias("n"))


def _gathered(work: DataFrame, prefixes: dict[int, np.ndarray], used: int) -> DataFrame:
    """(c, bits, n): the values whose first bits are a wanted prefix."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, wanted in prefixes.items():
                bits, n = _column_bits(batch, c)
                own = bits >> np.uint64(64 - used)
                inside = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                values, place = np.unique(bits[inside], return_inverse=True)
                n = np.bincount(place, None if n is None else n[inside], minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), c, dtype=np.int32)), pa.array(values.view(np.int64)), pa.array(n)], ["c", "bits", "n"])

    return work.mapInArrow(fetch, "c int, bits long, n long").groupBy("c", "bits").agg(F.sum("n").alias("n"))


def _selected(work: DataFrame, columns: int, probs: Sequence[float]) -> dict[int, tuple[int, dict[int, float]]]:
    """Per column the number of values, and the value at each wanted rank.

    What reaches the driver is one bin per column and rank, then at most GATHERED values.
    """
    spark = work.sparkSession
    counts = _bin_counts(work, {c: np.zeros(1, dtype=np.uint64) for c in range(columns)}, 0, LEADING_BITS)
    whole = Window.partitionBy("c")
    running = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    spots = [(F.col("all") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)])
    bins = counts.withColumn("all", F.sum("n").over(whole)).withColumn("upto", F.sum("n").over(running))
    held = F.exists(ranks, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    sizes, wanted = {}, []  # wanted: (c, rank, prefix, rank within the prefix, values with the prefix)
    for r in bins.where(held).collect():
        sizes[r["c"]] = r["all"]
        for p in probs:
            for rank in {math.floor((r["all"] - 1) * float(p)), math.ceil((r["all"] - 1) * float(p))}:
                if r["upto"] - r["n"] <= rank < r["upto"]:
                    wanted.append((r["c"], rank, r["bin"], rank - (r["upto"] - r["n"]), r["n"]))
    used = LEADING_BITS
    while used < 64 and sum({(c, prefix): n for c, _, prefix, _, n in wanted}.values()) > GATHERED:
        width = min(LEADING_BITS, 64 - used)
        by_column = {c: np.array(sorted({w[2] for w in wanted if w[0] == c}), dtype=np.uint64) for c in sizes}
        counts = _bin_counts(work, by_column, used, width)
        running = Window.partitionBy("c", "prefix").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        asked = spark.createDataFrame(
            [(c, rank, _signed(prefix), at) for c, rank, prefix, at, _ in dict.fromkeys(wanted)], "c int, rank long, prefix long, at long")
        bins = counts.withColumn("upto", F.sum("n").over(running)).join(F.broadcast(asked), ["c", "prefix"])
        inside = bins.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
        wanted = [
            (r["c"], r["rank"], ((r["prefix"] % (1 << 64)) << width) + r["bin"], r["at"] - (r["upto"] - r["n"]), r["n"]) for r in inside.collect()
        ]
        used += width
    values: dict[int, dict[int, float]] = {c: {} for c in sizes}
    if used == 64:
        for c, rank, prefix, _, _ in wanted:
            values[c][rank] = float(number_of(np.array([prefix], dtype=np.uint64))[0])
    else:
        by_column = {c: np.array(sorted({w[2] for w in wanted if w[0] == c}), dtype=np.uint64) for c in sizes}
        rows = _gathered(work, by_column, used).toPandas() if sizes else None
        for c, prefixes in by_column.items():
            mine = rows[rows["c"] == c]
            bits, n = mine["bits"].to_numpy().view(np.uint64), mine["n"].to_numpy()
            order = np.argsort(bits)
            bits, n = bits[order], n[order]
            for prefix in prefixes:
                inside = bits >> np.uint64(64 - used) == prefix
                upto, numbers = np.cumsum(n[inside]), number_of(bits[inside])
                for w in wanted:
                    if w[0] == c and w[2] == int(prefix):
                        values[c][w[1]] = float(numbers[np.searchsorted(upto, w[3], side="right")])
    return {c: (sizes[c], values[c]) for c in sizes}


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


@F.pandas_udf(LongType())
def _sortable(values: pd.Series) -> pd.Series:
    """Signed integers in the order of the numbers."""
    return pd.Series((ordered_bits(values.to_numpy(dtype=np.float64)) ^ np.uint64(1 << 63)).view(np.int64))


def _group_quantiles(df: DataFrame, column: str, probs: Sequence[float], by: list[str]) -> DataFrame:
    """quantiles() of one column in each group: three counts by 20, 22 and 22 bits.

    The bins of a group are rows, combined before they move, so a group that holds
    a third of the table costs no more than its bins.
    """
    value = F.col("v")
    work = df.select(F.struct(*[quoted(b).alias(f"g{i}") for i, b in enumerate(by)]).alias("g"), quoted(column).cast("double").alias("v"))
    work = work.where(value.isNotNull() & ~F.isnan(value))
    bits = work.withColumn("k", _sortable("v"))
    left, levels = 64, []
    for width in GROUP_BITS:
        left -= width
        levels.append(F.shiftright("k", left))  # the leading bits so far
    ranked = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[f(s).cast("long") for s in ranked for f in (F.floor, F.ceil)])

    rows, wanted = bits, None
    for level, prefix in enumerate(levels):
        within = ["g"] if not level else ["g", "p"]
        keyed = rows.withColumn("q", prefix)
        counts = keyed.groupBy(*within, "q").agg(F.count("*").alias("m"), F.max("v").alias("v"))
        running = Window.partitionBy(*within).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("before", F.sum("m").over(running) - F.col("m"))
        if not level:
            placed = counts.withColumn("n", F.sum("m").over(Window.partitionBy("g")))
            placed = placed.select("*", F.posexplode(ranks).alias("j", "at"))
        else:
            placed = counts.join(wanted, ["g", "p"])
        inside = placed.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("m")))
        wanted = inside.select("g", "n", "j", F.col("q").alias("p"), (F.col("at") - F.col("before")).alias("at"), "v")
        if level + 1 < len(levels):
            wanted = wanted.drop("v")
            rows = bits.withColumn("p", prefix).join(wanted.select("g", "p").distinct(), ["g", "p"], "left_semi")
    ends = [F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"e{j}") for j in range(2 * len(probs))]
    found = wanted.groupBy("g").agg(F.max("n").alias("n"), *ends)
    low, high = (lambda j: F.col(f"e{2 * j}")), (lambda j: F.col(f"e{2 * j + 1}"))
    return found.select(
        *[F.col(f"g.g{i}").alias(b) for i, b in enumerate(by)],
        F.lit(column).alias("column"),
        "n",
        *[
            F.when(low(j) == high(j), low(j)).otherwise(low(j) + (s - F.floor(s)) * (high(j) - low(j))).alias(f"q{j}")
            for j, s in enumerate(ranked)
        ],
    )
