"""COUNT, SUM and AVG under a value predicate, regions and points, and their accounting."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.functions.expr import IN, MAYBE, OUT, block_axes, block_bounds, block_error, cell_axes, n_valid, next_down, next_up
from gridstone.plans import planner
from gridstone.plans.options import QueryOptions
from gridstone.sources.store import Store, decoded, decoding, existing, folder_blocks, layer_columns

_DEFAULT = QueryOptions()
#: Blocks that a task decodes at least, as far as there are so many.
TASK_BLOCKS = 2048


def _scan(store: Store, plan: planner.Plan, wanted: Column, n: int) -> DataFrame:
    """The n wanted rows of the payload, in the ranges of a plan: its folders, row groups and pages outside them aren't read."""
    rows, folders = store.payload, plan.folders(folder_blocks(store.spec))
    if folders is not None:
        rows = rows.where(F.col("part").isin(folders))
    rows = rows.where(plan.within() & wanted)
    return rows.coalesce(1) if n <= TASK_BLOCKS else rows


def _counted(rows: DataFrame, store: Store, layer: int, lo: float, hi: float, most_bytes: int | None = None) -> DataFrame:
    """(n): values of rows' blocks in the range, counted where they are decoded; a row for each batch."""
    values = decoding(store.spec, layer, 1, most_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in values(batches):
            met = (v > np.float64(lo)) & (v <= np.float64(hi)) & existing(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int(met.sum())], pa.int64())], ["n"])

    return rows.select("valid", *layer_columns(store.spec, layer)).mapInArrow(work, "n long")


def _one(store: Store, *columns: Column) -> DataFrame:
    return store.spark.range(1).select(*columns)


def count(store: Store, lo: float, hi: float, options: QueryOptions = _DEFAULT) -> DataFrame:
    """One row: the exact count of decoded values with lo < x <= hi, and the blocks of each state.

    The zone map is read when this is called: one pass tells how many values lie in blocks
    that are wholly inside, and in which ranges the undecided blocks are. Only these ranges
    of the payload are read, and only undecided blocks of them decoded.
    """
    layer, began = options.layer_of(store.spec), time.time()
    plan = planner.planned(store.zone_map, store.spec, lo, hi, layer)
    traced = [F.lit(round(time.time() - began, 6)).alias("planning_seconds")] if options.trace else []
    if not plan.ranges:
        return _one(store, F.lit(plan.in_values).cast("long").alias("count"), *plan.counts(), *traced)
    rows = _scan(store, plan, planner.states_of(store.spec, lo, hi, layer) == MAYBE, plan.maybe_blocks)
    met = _counted(rows, store, layer, lo, hi, options.max_inflight_bytes).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))
    return met.select((F.lit(plan.in_values) + F.col("met")).cast("long").alias("count"), *plan.counts(), *traced)


_TOTALS = {"count": "sum", "sum": "sum", "n": "sum", "total": "sum", "sure": "sum", "sure_lo": "sum", "sure_hi": "sum", "may": "sum", "neg": "sum", "pos": "sum", "least": "min", "most": "max"}
_WHOLE = ("count", "n", "sure", "may")


def _totals(v: np.ndarray, exist: np.ndarray, inside: np.ndarray, eps: np.ndarray, lo: float, hi: float) -> dict[str, float]:
    """Totals of blocks' values (n, 64): those that are in the range, surely or maybe, as decoded and as originals."""
    r, e = v.astype(np.float64), eps[:, None]
    a, b, all_in = r - e, r + e, inside[:, None]
    hit = exist & (all_in | ((r > lo) & (r <= hi)))
    sure = exist & (all_in | ((a > lo) & (b <= hi)))
    may = exist & ~sure & ~((b <= lo) | (a > hi))
    low, high = np.maximum(a, lo), np.minimum(b, hi)
    return {
        "count": int(hit.sum()),
        "sum": float(r[hit].sum()),
        "n": int(exist.sum()),
        "total": float((np.abs(r) + e)[exist].sum()),
        "sure": int(sure.sum()),
        "sure_lo": float(low[sure].sum()),
        "sure_hi": float(high[sure].sum()),
        "may": int(may.sum()),
        "neg": float(np.minimum(low[may], 0).sum()),
        "pos": float(np.maximum(high[may], 0).sum()),
        "least": float(low[may].min(initial=np.inf)),
        "most": float(high[may].max(initial=-np.inf)),
    }


def _partial(rows: DataFrame, store: Store, lo: float, hi: float, most_bytes: int | None = None) -> DataFrame:
    """_totals() of rows (state, eps, valid, layers...), a row for each batch."""
    values = decoding(store.spec, 0, 3, most_bytes)
    kinds = {k: pa.int64() if k in _WHOLE else pa.float64() for k in _TOTALS}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in values(batches):
            got = _totals(v, existing(part.column(2)), part.column(0).to_numpy() == IN, part.column(1).to_numpy(), lo, hi)
            yield pa.RecordBatch.from_arrays([pa.array([got[k]], t) for k, t in kinds.items()], list(kinds))

    return rows.mapInArrow(work, ", ".join(f"`{k}` {'long' if k in _WHOLE else 'double'}" for k in _TOTALS))


def aggregate(store: Store, lo: float, hi: float, options: QueryOptions = _DEFAULT, return_blocks: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """One row: exact count, sum and mean of decoded values with lo < x <= hi, and intervals that hold the originals' own.

    A value r of a block with error e stands for an original in [r - e, r + e]. Originals
    surely in the range give the lower sum and count, those that may be the rest. Each batch
    of decoded blocks gives one row of totals. return_blocks: a second table has the
    (chunk_id, pos) of all blocks that are read, in order.
    """
    spec = store.spec
    if options.layer not in (None, 0) or (options.layer is None and spec.top):
        raise ValueError("aggregates read layer 0 only; pass layer=0 for an array of several layers")
    plan = planner.planned(store.zone_map, spec, lo, hi, 0, inside=True)
    states = planner.states_of(spec, lo, hi)
    rows = _scan(store, plan, states != OUT, plan.in_blocks + plan.maybe_blocks).select(states.alias("state"), block_error(spec).alias("eps"), "valid", *layer_columns(spec, 0))
    sums = _partial(rows, store, lo, hi, options.max_inflight_bytes).agg(
        *[F.coalesce(F.sum(k), F.lit(0).cast("long" if k in _WHOLE else "double")).alias(k) if how == "sum" else {"min": F.min, "max": F.max}[how](k).alias(k) for k, how in _TOTALS.items()]
    )
    # Sums come in any order: twice the error that any order can have, and steps outward for the roundings that follow.
    slack = 2 * (F.col("n") + 2) * F.lit(2.0**-53) * F.col("total")
    down = lambda x: next_down(x - F.abs(x) * F.lit(2.0**-50))
    up = lambda x: next_up(x + F.abs(x) * F.lit(2.0**-50))
    sure, may = F.col("sure"), F.col("may")
    sure_lo, sure_hi = F.col("sure_lo") - slack, F.col("sure_hi") + slack
    lo_mean = F.when(sure > 0, F.least(sure_lo / sure, F.when(may > 0, (sure_lo + may * F.col("least")) / (sure + may)))).when(may > 0, F.col("least"))
    hi_mean = F.when(sure > 0, F.greatest(sure_hi / sure, F.when(may > 0, (sure_hi + may * F.col("most")) / (sure + may)))).when(may > 0, F.col("most"))
    row = sums.select(
        "count",
        "sum",
        F.when(F.col("count") > 0, F.col("sum") / F.col("count")).alias("mean"),
        sure.alias("original_count_lo"),
        (sure + may).alias("original_count_hi"),
        down(sure_lo + F.col("neg")).alias("original_sum_lo"),
        up(sure_hi + F.col("pos")).alias("original_sum_hi"),
        F.when(lo_mean.isNotNull(), down(F.coalesce(lo_mean, F.lit(0.0)))).alias("original_mean_lo"),
        F.when(hi_mean.isNotNull(), up(F.coalesce(hi_mean, F.lit(0.0)))).alias("original_mean_hi"),
        *plan.counts(),
    )
    if not return_blocks:
        return row
    listed = planner.to_aggregate(planner.classified(store.zone_map, spec, lo, hi)).select("chunk_id", "pos")
    return row, listed.orderBy("chunk_id", "pos")


def accounting(store: Store, lo: float, hi: float, options: QueryOptions = _DEFAULT, inside: bool = False) -> DataFrame:
    """One row: what a reader of byte ranges would fetch for a COUNT (inside: for an aggregate), with reads merged over gaps.

    A model of such a reader, not a measure of this one: sources/counting.py measures bytes
    that Spark has read.
    """
    spec, layer = store.spec, options.layer_of(store.spec)
    states = planner.classified(store.zone_map, spec, lo, hi, layer)
    listed = planner.to_aggregate(states) if inside else planner.to_count(states)
    width = spec.prefix_bytes(layer)
    read = planner.reads(listed, spec, layer, options.merge_gap_blocks, options.max_chunk_requests)
    of_units = states.agg((F.count_distinct("unit_id") * spec.record_bytes).alias("metadata_bytes_read"), (F.count_if(F.col("state") == MAYBE) + (F.count_if(F.col("state") == IN) if inside else F.lit(0))).alias("listed"))
    row = read.crossJoin(of_units)  # one row each
    useful = F.col("listed") * width
    return row.select(
        useful.cast("long").alias("useful_payload_bytes"),
        "payload_bytes_read",
        (F.col("payload_bytes_read") - useful).cast("long").alias("payload_overread_bytes"),
        F.col("metadata_bytes_read").cast("long").alias("metadata_bytes_read"),
        "payload_requests",
        F.lit(spec.objects).cast("long").alias("metadata_requests"),
        (F.col("payload_bytes_read") + F.col("metadata_bytes_read")).cast("long").alias("bytes_read"),
        (F.col("payload_requests") + F.lit(spec.objects)).cast("long").alias("range_requests"),
    )


def full_scan_count(store: Store, lo: float, hi: float) -> DataFrame:
    """The same count by decoding everything."""
    return _counted(store.payload, store, store.spec.top, lo, hi).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"))


def count_interval(store: Store, lo: float, hi: float) -> DataFrame:
    """Bounds of the originals' count from the zone map alone."""
    states = planner.classified(store.zone_map, store.spec, lo, hi)
    n = lambda *s: F.coalesce(F.sum(F.when(F.col("state").isin(*s), F.col("n"))), F.lit(0)).cast("long")
    return states.agg(n(IN).alias("count_lo"), n(IN, MAYBE).alias("count_hi"))


# ---------------------------------------------------------------- places


def cells_of(store: Store, blocks: DataFrame) -> DataFrame:
    """(t, y, x, v) of decoded blocks (chunk_id, pos, valid, v), for any order of blocks; padding is left out."""
    rows = blocks.select("chunk_id", "pos", "valid", F.posexplode("v").alias("cell", "v"))
    rows = rows.where(F.col("valid").isNull() | (F.getbit("valid", F.col("cell")) == 1))
    return rows.select(*[c.alias(a) for a, c in zip("tyx", cell_axes(store.spec), strict=True)], "v")


def _axes(store: Store, rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("*", *[c.alias(a) for a, c in zip(("bt", "by", "bx"), block_axes(store.spec), strict=True)], *more)


def _over(store: Store, y: tuple[int, int], x: tuple[int, int]) -> Column:
    """A filter that Parquet takes down to its pages: where in their chunk blocks that a box meets lie, if it meets the chunks at one place of the grid alone."""
    spec = store.spec
    cy, cx = ((ends[0] // c, (ends[1] - 1) // c) for ends, c in ((y, spec.chunk[1]), (x, spec.chunk[2])))
    if cy[0] != cy[1] or cx[0] != cx[1]:
        return F.lit(True)
    pos = np.arange(spec.blocks_per_chunk)
    _, by, bx = spec.corners(np.zeros_like(pos), pos)
    inside = lambda b, ends, c, size: (b + 4 > ends[0] - c * size) & (b < ends[1] - c * size)
    met = np.flatnonzero(inside(by, y, cy[0], spec.chunk[1]) & inside(bx, x, cx[0], spec.chunk[2]))
    return F.col("pos").between(int(met.min()), int(met.max())) if len(met) else F.lit(False)


def point_series(store: Store, points: DataFrame) -> DataFrame:
    """(t, y, x, v) of points (y, x) over all t: only blocks over a point are decoded, each once. points are few: a request's own."""
    near = points.select(F.floor(F.col("y") / 4).cast("int").alias("by"), F.floor(F.col("x") / 4).cast("int").alias("bx")).distinct()
    ends = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "yx" for f in (F.min, F.max)]).first()
    box = ((ends.min_y, ends.max_y + 1), (ends.min_x, ends.max_x + 1)) if ends.min_y is not None else ((0, 1), (0, 1))
    rows = _axes(store, store.payload.where(_over(store, *box))).join(F.broadcast(near), ["by", "bx"], "left_semi")
    return cells_of(store, decoded(rows, store.spec)).join(F.broadcast(points.select("y", "x").distinct()), ["y", "x"], "left_semi").select("t", "y", "x", "v")


def _touching(y: tuple[int, int], x: tuple[int, int]) -> Column:
    """Blocks (by, bx) that a half-open box meets."""
    return F.col("by").between(y[0] // 4, (y[1] - 1) // 4) & F.col("bx").between(x[0] // 4, (x[1] - 1) // 4)


_REGION = {"n": "sum", "sum": "sum", "min": "min", "max": "max", "eps": "max", "unit_sum": "sum", "block_sum": "sum"} | {f"{w}_{m}_{s}": m for w in ("unit", "block") for m in ("min", "max") for s in ("lo", "hi")}


def region(store: Store, y: tuple[int, int], x: tuple[int, int], layer: int | None = None) -> DataFrame:
    """AVG, MIN and MAX of decoded values in a half-open box at a layer's rate, with bounds of their errors, three for each.

    _a: the largest error of the units that the box meets. _b: for AVG the mean of its values'
    unit errors, for MIN and MAX what intervals of these errors around the values allow.
    _c: the same with each block's own error. blocks: how many were decoded.
    """
    spec, top = store.spec, store.spec.top if layer is None else layer
    rows = _axes(store, store.payload.where(_over(store, y, x))).where(_touching(y, x))
    rows = rows.select("by", "bx", F.col(f"eps{top}").alias("unit"), block_error(spec, top).alias("block"), "valid", *layer_columns(spec, top))
    values = decoding(spec, top, 5)
    inner = np.indices((4, 4, 4)).reshape(3, 64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in values(batches):
            by, bx, unit, block = (part.column(k).to_numpy()[:, None] for k in range(4))
            cy, cx = by * 4 + inner[1], bx * 4 + inner[2]
            ok = existing(part.column(4)) & (cy >= y[0]) & (cy < y[1]) & (cx >= x[0]) & (cx < x[1])
            r = v.astype(np.float64)
            got = {"n": int(ok.sum()), "sum": r[ok].sum(), "min": r[ok].min(initial=np.inf), "max": r[ok].max(initial=-np.inf), "eps": unit.max(initial=0.0)}
            for name, e in (("unit", unit), ("block", block)):
                e = np.broadcast_to(e, r.shape)
                low, high = (r - e)[ok], (r + e)[ok]
                got |= {f"{name}_sum": e[ok].sum(), f"{name}_min_lo": low.min(initial=np.inf), f"{name}_min_hi": high.min(initial=np.inf), f"{name}_max_lo": low.max(initial=-np.inf), f"{name}_max_hi": high.max(initial=-np.inf)}
            yield pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), *[pa.array([got[k]], pa.int64() if k == "n" else pa.float64()) for k in _REGION]], ["blocks", *_REGION])

    parts = rows.mapInArrow(work, "blocks long, " + ", ".join(f"`{k}` {'long' if k == 'n' else 'double'}" for k in _REGION))
    whole = parts.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), *[{"sum": F.sum, "min": F.min, "max": F.max}[how](k).alias(k) for k, how in _REGION.items()])
    n, c = F.col("n"), F.col
    some = lambda v: F.when(n > 0, v)
    off = lambda w, m: minmax_bound(c(m), c(f"{w}_{m}_lo"), c(f"{w}_{m}_hi"))
    bounds = [c("eps").alias(f"{m}_bound_a") for m in ("avg", "min", "max")]
    for letter, w in (("b", "unit"), ("c", "block")):
        bounds += [some(c(f"{w}_sum") / n).alias(f"avg_bound_{letter}"), some(off(w, "min")).alias(f"min_bound_{letter}"), some(off(w, "max")).alias(f"max_bound_{letter}")]
    return whole.select(F.coalesce(n, F.lit(0)).alias("n"), some(c("sum") / n).alias("avg"), some(c("min")).alias("min"), some(c("max")).alias("max"), "eps", "blocks", *bounds)


def minmax_bound(got: Column, lo: Column, hi: Column) -> Column:
    """How far the true minimum (or maximum) may be from the decoded one, if it lies in [lo, hi]."""
    return F.greatest(hi - got, got - lo)


def region_meta_minmax(store: Store, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Intervals of the originals' minimum and maximum in a box, from the zone map alone.

    Blocks that the box meets give the outer ends, blocks wholly in it the inner ones, which
    units wholly in it tighten by their exact bounds. A box over the whole grid is exact.
    """
    spec = store.spec
    bmin, bmax = block_bounds()
    z = _axes(store, store.zone_map).where(_touching(y, x)).select("by", "bx", F.col("cmin").cast("double"), F.col("cmax").cast("double"), bmin.alias("lo"), bmax.alias("hi"))
    within = lambda c, size, ends: (F.floor(F.col(c) * 4 / size) * size >= ends[0]) & (F.floor(F.col(c) * 4 / size) * size + size <= ends[1])
    inside = within("by", 4, y) & within("bx", 4, x)
    whole = within("by", spec.unit[1], y) & within("bx", spec.unit[2], x)
    ends = z.agg(
        F.min("lo").alias("min_lo"),
        F.max("hi").alias("max_hi"),
        F.coalesce(F.min(F.when(inside, F.col("hi"))), F.max("hi")).alias("min_hi"),
        F.coalesce(F.max(F.when(inside, F.col("lo"))), F.min("lo")).alias("max_lo"),
        F.min(F.when(whole, F.col("cmin"))).alias("unit_min"),
        F.max(F.when(whole, F.col("cmax"))).alias("unit_max"),
    )
    exact = F.lit(y[0] <= 0 and x[0] <= 0 and y[1] >= spec.shape[1] and x[1] >= spec.shape[2])
    return ends.select(
        F.when(exact, F.col("unit_min")).otherwise(F.col("min_lo")).alias("min_lo"),
        F.least("min_hi", "unit_min").alias("min_hi"),
        F.greatest("max_lo", "unit_max").alias("max_lo"),
        F.when(exact, F.col("unit_max")).otherwise(F.col("max_hi")).alias("max_hi"),
    )


def region_read_cost(store: Store, y: tuple[int, int], x: tuple[int, int], layer: int | None = None) -> DataFrame:
    """One row (bytes): the payload of the blocks that a box meets at a layer's rate, and their units' records."""
    spec, top = store.spec, store.spec.top if layer is None else layer
    z = _axes(store, store.zone_map).where(_touching(y, x))
    return z.agg((F.count("*") * spec.prefix_bytes(top) + F.count_distinct("unit_id") * spec.record_bytes).alias("bytes"))


def max_error(store: Store, cells: DataFrame) -> DataFrame:
    """(blocks, err, eps, held): the largest difference between decoded and original values, against what the zone map promises."""
    got = cells_of(store, decoded(store.payload, store.spec)).withColumnRenamed("v", "r")
    err = F.abs(F.col("v").cast("double") - F.col("r").cast("double"))
    worst = cells.join(got, ["t", "y", "x"]).agg(F.max(err).alias("err"))
    promised = store.zone_map.agg(F.count("*").alias("blocks"), F.max(f"eps{store.spec.top}").alias("eps"), F.sum(n_valid()).alias("n"))
    return worst.crossJoin(promised).select("blocks", "err", "eps", (F.col("err") <= F.col("eps")).alias("held"))
