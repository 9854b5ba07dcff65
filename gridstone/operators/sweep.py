"""Sweeps over what a query may vary in: selectivity, gap between merged reads, layout."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.operators import explore, query
from gridstone.plans import planner
from gridstone.plans.options import QueryOptions
from gridstone.sources.store import Store, create

#: Shares of all values above the thresholds of a sweep.
SELECTIVITIES = (0.001, 0.01, 0.05, 0.1, 0.2, 0.5)


def gaps(store: Store, lo: float, hi: float, tried: tuple[int, ...]) -> DataFrame:
    """(gap, payload_requests, payload_bytes_read): a COUNT's reads when neighbours at most so many blocks apart are merged."""
    spec = store.spec
    listed = planner.to_count(planner.classified(store.zone_map, spec, lo, hi, spec.top))
    rows = [planner.reads(listed, spec, spec.top, gap, 1 << 30).select(F.lit(gap).cast("long").alias("gap"), "*") for gap in tried]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def selectivities(store: Store, cells: DataFrame, tried: tuple[float, ...] = SELECTIVITIES) -> DataFrame:
    """(selectivity, threshold, count, truth, count_error, maybe_fraction, requests, bytes) of COUNTs above the thresholds that shares of the originals exceed."""
    out = []
    for cut in explore.thresholds(cells, tried).collect():
        row = query.count(store, cut.threshold, math.inf).crossJoin(query.accounting(store, cut.threshold, math.inf)).first()  # one row each
        error = abs(row["count"] - cut.true_count) / cut.true_count if cut.true_count else 0.0
        out.append((cut.selectivity, cut.threshold, row["count"], cut.true_count, error, row.maybe_blocks / row.total_blocks, row.range_requests, row.bytes_read))
    return cells.sparkSession.createDataFrame(out, "selectivity double, threshold double, count long, truth long, count_error double, maybe_fraction double, requests long, bytes long")


def ablation(store: Store, cells: DataFrame, lo: float) -> DataFrame:
    """(config, factor, count, maybe_blocks, requests, bytes): a COUNT above lo with one thing changed at a time.

    Layouts are written anew from the cells: other orders of blocks, codes of errors, layers.
    no_pruning decodes every block.
    """
    spec, width = store.spec, store.spec.prefix_bytes(store.spec.top)
    stores = {
        "default": ("none", store, QueryOptions()),
        "gap_0": ("merge_gap", store, QueryOptions(merge_gap_blocks=0)),
        "gap_64k": ("merge_gap", store, QueryOptions(merge_gap_blocks=64_000 // width)),
        "order_time": ("block_order", create(cells, replace(spec, block_order=(1, 2, 0))), QueryOptions()),
        "layers": ("layers", create(cells, replace(spec, layers=(spec.rate / 2, spec.rate))), QueryOptions(max_chunk_requests=1 << 30)),
        "codes": ("summary_precision", create(cells, replace(spec, block_error_bits=4)), QueryOptions()),
    }
    out = []
    for name, (factor, s, options) in stores.items():
        row = query.count(s, lo, math.inf, options).crossJoin(query.accounting(s, lo, math.inf, options)).first()  # one row each
        out.append((name, factor, row["count"], row.maybe_blocks, row.range_requests, row.bytes_read))
    n = query.full_scan_count(store, lo, math.inf).first()["count"]
    out.append(("no_pruning", "pruning", n, spec.stored_blocks, spec.n_chunks, spec.stored_blocks * width))
    return cells.sparkSession.createDataFrame(out, "config string, factor string, count long, maybe_blocks long, requests long, bytes long")
