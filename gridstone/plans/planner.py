"""Plans over the zone map: states, lists of blocks to read, ranges that a scan is cut down to, merged reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions.expr import IN, MAYBE, OUT, block_bounds, block_error, n_valid, state
from gridstone.plans.spec import ArraySpec

#: Bytes between two reads that are cheaper to read than to skip.
GAP_BYTES = 256_000
#: Rows that the driver gets of a plan at most, and ranges that a scan's filter has at most.
MOST_BUCKETS, MOST_RANGES = 4096, 48
#: Zone-map rows that one task passes over: a smaller zone map is planned without a shuffle.
TASK_BLOCKS = 1 << 18


def states_of(spec: ArraySpec, lo: float, hi: float, layer: int = 0) -> Column:
    bmin, bmax = block_bounds()
    return state(bmin, bmax, block_error(spec, layer), lo, hi)


def classified(zone_map: DataFrame, spec: ArraySpec, lo: float, hi: float, layer: int = 0) -> DataFrame:
    """(block, chunk_id, unit_id, pos, state, eps, n): one narrow projection of the zone map."""
    return zone_map.select("block", "chunk_id", "unit_id", "pos", states_of(spec, lo, hi, layer).alias("state"), block_error(spec, layer).alias("eps"), n_valid().alias("n"))


def to_count(states: DataFrame) -> DataFrame:
    """Blocks that a COUNT must decode."""
    return states.where(F.col("state") == MAYBE)


def to_aggregate(states: DataFrame) -> DataFrame:
    """Blocks that an aggregate must decode."""
    return states.where(F.col("state") != OUT)


def state_counts() -> list[Column]:
    return [F.count_if(F.col("state") == s).alias(n) for s, n in ((IN, "in_blocks"), (OUT, "out_blocks"), (MAYBE, "maybe_blocks"))] + [F.count("*").alias("total_blocks")]


@dataclass(frozen=True)
class Plan:
    """What a pass over the zone map tells: blocks by state, values of those inside, and the ranges of blocks to read."""

    in_blocks: int
    out_blocks: int
    maybe_blocks: int
    total_blocks: int
    in_values: int
    maybe_values: int
    ranges: tuple[tuple[int, int], ...]

    def counts(self) -> list[Column]:
        return [F.lit(getattr(self, k)).cast("long").alias(k) for k in ("in_blocks", "out_blocks", "maybe_blocks", "total_blocks")]

    def within(self, block: str = "block") -> Column:
        """A filter on block numbers that Parquet takes down to its pages."""
        out = F.lit(False)
        for k, (first, last) in enumerate(self.ranges):
            part = (F.col(block) >= first) & (F.col(block) <= last)
            out = part if not k else out | part
        return out

    def folders(self, per_folder: int) -> list[int] | None:
        """The folders that the ranges touch; None if they are too many to name."""
        n = sum(last // per_folder - first // per_folder + 1 for first, last in self.ranges)
        return sorted({p for first, last in self.ranges for p in range(first // per_folder, last // per_folder + 1)}) if n <= MOST_BUCKETS else None


def joined_ranges(ranges: list[tuple[int, int]], most: int = MOST_RANGES) -> tuple[tuple[int, int], ...]:
    """At most so many ranges that cover these, by closing the smallest gaps."""
    ranges = sorted(ranges)
    gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1], reverse=True)
    cuts = sorted(k for k in gaps[: most - 1] if ranges[k][0] > ranges[k - 1][1] + 1)
    edges = [0, *cuts, len(ranges)]
    return tuple((ranges[a][0], max(r[1] for r in ranges[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def planned(zone_map: DataFrame, spec: ArraySpec, lo: float, hi: float, layer: int = 0, inside: bool = False) -> Plan:
    """One pass over the zone map, pre-aggregated by buckets of neighbouring blocks, of which the driver gets MOST_BUCKETS at most.

    inside: blocks that lie wholly in the range are read too.
    """
    step = -(-spec.total_blocks // MOST_BUCKETS)
    states = classified(zone_map if spec.stored_blocks > TASK_BLOCKS else zone_map.coalesce(1), spec, lo, hi, layer)
    read = (F.col("state") != OUT) if inside else (F.col("state") == MAYBE)
    values = [F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(k) for s, k in ((IN, "in_values"), (MAYBE, "maybe_values"))]
    rows = states.groupBy(F.floor(F.col("block") / step)).agg(*state_counts(), *values, F.min(F.when(read, F.col("block"))).alias("first"), F.max(F.when(read, F.col("block"))).alias("last")).collect()
    total = {k: sum(r[k] for r in rows) for k in ("in_blocks", "out_blocks", "maybe_blocks", "total_blocks", "in_values", "maybe_values")}
    return Plan(**total, ranges=joined_ranges([(r["first"], r["last"]) for r in rows if r["first"] is not None]))


# ---------------------------------------------------------------- merged reads


def gap_blocks(block_bytes: int, gap: int | None = None) -> int:
    return GAP_BYTES // block_bytes if gap is None else gap


def merged(blocks: DataFrame, gap: int, most: int | None = None) -> DataFrame:
    """(chunk_id, first, last, blocks): neighbours at most gap blocks apart become one read, of at most so many blocks."""
    along = W.partitionBy("chunk_id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(along) <= gap + 1, 0).otherwise(1)
    run = blocks.withColumn("_n", new).withColumn("run", F.sum("_n").over(along))
    if most:
        first = F.min("pos").over(W.partitionBy("chunk_id", "run"))
        run = run.withColumn("part", F.floor((F.col("pos") - first) / most))
    keys = ["chunk_id", "run"] + (["part"] if most else [])
    return run.groupBy(*keys).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("blocks")).drop("run", "part")


def merged_ranges(ranges: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """Ranges of any size: one joins those before it if it begins at most gap behind the furthest end so far."""
    order = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col(start) <= reach + gap, 0).otherwise(1)
    run = ranges.withColumn("_n", new).withColumn("run", F.sum("_n").over(order))
    return run.groupBy(key, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("run")


def reads(blocks: DataFrame, spec: ArraySpec, layer: int = 0, gap: int | None = None, most_chunk_reads: int = 1) -> DataFrame:
    """One row: what a reader of byte ranges would fetch for these blocks: payload_requests and payload_bytes_read, a model.

    Each layer of a chunk is a section of its own. Above layer 0, a chunk that would need more
    than most_chunk_reads reads is fetched whole, in one read.
    """
    width, sections = spec.prefix_bytes(layer), layer + 1
    runs = merged(blocks, gap_blocks(width, gap)).groupBy("chunk_id").agg(F.count("*").alias("n"), F.sum(F.col("last") - F.col("first") + 1).alias("span"))
    whole = F.lit(layer > 0) & (F.col("n") * sections > most_chunk_reads)
    n = F.when(whole, 1).otherwise(F.col("n") * sections)
    size = F.when(whole, F.lit(spec.blocks_per_chunk)).otherwise(F.col("span")) * width
    return runs.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("payload_requests"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("payload_bytes_read"))
