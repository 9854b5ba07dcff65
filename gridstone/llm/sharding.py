"""Shards that each hold the corpus's mixture: proportional stratified interleaving."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.llm.common import checkpoint, mark_for, named

#: Rows that one ranking task gets at about the most.
BUCKET_ROWS = 20_000


def shuffle_key(id_column: str, seed: int) -> Column:
    """60 uniform bits from the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def interleave(df: DataFrame, n_shards: int, id_column: str = "doc_id", source: str = "source", seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with shard and slot: rows are dealt so that every shard has each source's share, and sizes in rows differ by one at most.

    Within a source, rows are ranked by a seeded hash of their id; the fraction
    (rank - 1/2) / rows orders all rows, and equal cuts of this order are the shards.

    Ranks come from counts by hash range: a hot source is split into ranges of about
    BUCKET_ROWS rows, each ranked apart from an offset that pre-aggregated counts give.

    Null source: a source of its own. Null id: hashed like the word null. Repeated rows:
    each is placed; which of equal rows comes first doesn't matter. Empty table: no rows.
    Columns named shard or slot in df are replaced, any other kept, whatever its name. ties: columns that order rows of
    equal id. df is kept in the checkpoint folder once: pass narrow columns, not texts.
    """
    n = df.count()
    bits = max(0, ceil(log2(max(n, 1) / BUCKET_ROWS)))
    spread, mark = 1 << bits, mark_for(df)
    key, stratum, part, count, before, total, fraction, start, place = (f"{mark}{x}" for x in ("key", "source", "range", "c", "before", "of_source", "fraction", "start", "place"))
    by = [named(id_column), *map(named, ties)]
    rows = df.drop("shard", "slot").withColumns({key: shuffle_key(id_column, seed), stratum: F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit(""))})
    rows = rows.withColumn(part, F.shiftright(key, 60 - bits) if bits else F.lit(0).cast("long"))
    # Offsets of each range of a source; counted from two narrow columns.
    counted = rows.groupBy(stratum, part).agg(F.count("*").alias(count))
    along = W.partitionBy(stratum).orderBy(part)
    offsets = counted.select(stratum, part, (F.sum(count).over(along) - F.col(count)).alias(before), F.sum(count).over(W.partitionBy(stratum)).alias(total))
    rank = F.col(before) + F.row_number().over(W.partitionBy(stratum, part).orderBy(key, *by))
    ranked = rows.join(offsets, [stratum, part]).withColumn(fraction, (2 * rank - 1).cast("double") / (2 * F.col(total)).cast("double"))
    ranked = checkpoint(ranked.withColumn(part, F.floor(F.col(fraction) * spread)).drop(before, total))
    # Where a range of the fractions starts in the whole order: a running sum over as many counts as there are ranges.
    filled = ranked.groupBy(part).agg(F.count("*").alias(count))
    starts = filled.select(part, (F.sum(count).over(W.orderBy(part)) - F.col(count)).alias(start))
    order = W.partitionBy(part).orderBy(fraction, stratum, key, *by)
    placed = ranked.join(F.broadcast(starts) if spread <= BUCKET_ROWS else starts, part)
    placed = placed.withColumn(place, F.col(start) + F.row_number().over(order) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(({place} * {n_shards}) div {max(n, 1)}L as int)"))
    slot = F.expr(f"{place} - ((shard * {n}L + {n_shards - 1}) div {n_shards})")
    return placed.withColumn("slot", slot).drop(key, stratum, part, fraction, start, place)
