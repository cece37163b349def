"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies.  The expected
copies are prefix-summed in the order (size class, hash of the id), one random
offset per source is added, and a document is taken once for every integer that
its interval crosses.  The order by size class makes the taken words follow the
target closely.  The prefix sum runs in buckets: rows per (source, size class,
hash range) are counted first, so that no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.shared import numbered

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_RANGE = 1_000_000


def word_count(text: Column | str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash32(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes per doubling, in the order of the sizes."""
    bits = F.length(F.bin(size))
    top = F.expr("0")
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, top)).bitwiseAND(7)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size) -> target: shares by weight, at most cap times the size, the excess shared again.

    With the sources in the order of cap / weight, a source is at its cap exactly
    if its cap does not exceed its share of what the earlier ones leave; whole
    numbers keep that exact.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * cap)
    by_room = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))
    ranked = ranked.withColumn("full", F.col("limit") * F.sum("weight").over(after) <= F.col("weight") * left)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    share = (F.col("weight") * open_words).cast("double") / open_weight.cast("double")
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All documents with `size`, `source_size`, `target` and `copies` (columns of these names are replaced).

    A null text has size 0; null is a source of its own, the last; a source
    without words gets no copies; an empty table gives an empty one.  Equal rows
    are sampled on their own, ties in hash and id go by the other columns, and reruns
    give the same copies.  `cap` bounds the copies of each document.  Other columns,
    whatever their names, are kept.
    """
    docs, names, (id_column, text, source), own = *numbered(docs, id_column, text, source), docs.columns
    kept = [(n, c) for n, c in zip(names, own) if c.lower() not in ("size", "source_size", "target", "copies")]
    own = [n for n, _ in kept]
    ident = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = docs.select(
        *own,
        F.col(source).alias("_src"),
        F.col(id_column).alias("_id"),
        _hash32(ident).alias("_hash"),
        F.xxhash64(*[F.col(c) for c in own if c != id_column]).alias("_tie"),
        word_count(text).alias("size"),
    ).withColumn("_class", _size_class(F.col("size")))
    ranges = 16 + docs.count() // ROWS_PER_RANGE
    rows = rows.withColumn("_range", F.shiftright(F.col("_hash") * ranges, 32))
    key = ["_src", "_class", "_range"]
    buckets = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_words"))
    targets = source_targets(buckets.groupBy(F.col("_src").alias("source")).agg(F.sum("_words").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("_src").orderBy("_class", "_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = _hash32(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")))) / F.lit(4294967296.0)
    starts = buckets.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = starts.join(targets, F.col("_src").eqNullSafe(F.col("source"))).select(
        *[F.col(c).alias(f"b{c}") for c in key],
        "_before",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_rate"),
        offset.alias("_offset"),
    )
    same = F.col("_src").eqNullSafe(F.col("b_src")) & (F.col("_class") == F.col("b_class")) & (F.col("_range") == F.col("b_range"))
    placed = rows.join(starts, same)
    in_bucket = Window.partitionBy(*key).orderBy("_hash", "_id", "_tie")
    rank = F.col("_before") + F.row_number().over(in_bucket)
    upto = lambda k: F.floor(k.cast("double") * F.col("_rate") + F.col("_offset"))
    placed = placed.withColumn("_rank", rank).withColumn("copies", (upto(F.col("_rank")) - upto(F.col("_rank") - 1)).cast("long"))
    return placed.select(*[F.col(n).alias(c) for n, c in kept], "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with their own columns, each as often as it is taken."""
    plain, names, (id_column, text, source) = numbered(docs, id_column, text, source)
    taken = mix(plain, id_column=id_column, text=text, source=source, **options)
    copies = taken.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op2_mixing(spark, folder: str) -> DataFrame:
    from gridlens.llm.shared import table

    taken = mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS lim, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    lim * CAST(sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)
      <= weight * (CAST(sum(source_size) OVER () AS BIGINT)
        - coalesce(CAST(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0)) AS capped
  FROM w
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(lim AS DOUBLE) ELSE
    CAST(weight * (total - coalesce(CAST(sum(CASE WHEN capped THEN lim END) OVER () AS BIGINT), 0)) AS DOUBLE)
      / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target,
    CAST(('0x' || substr(md5('mix' || coalesce(':' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY
      length(bin(d.size)) * 8 + ((d.size >> greatest(length(bin(d.size)) - 4, 0)) & 7),
      substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8), d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(CAST(k AS DOUBLE) * rate + u) - floor(CAST(k - 1 AS DOUBLE) * rate + u) AS BIGINT) AS taken
FROM r
"""
