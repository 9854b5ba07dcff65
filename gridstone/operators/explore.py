"""Intervals, samples, quantiles and statistics of runs around the core queries."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridstone.functions import codec
from gridstone.functions.expr import block_error, cell_axes, sort_key
from gridstone.operators.query import cells_of
from gridstone.sources.store import Store, blocks_of, decoded, indexed, shared_folder

# ---------------------------------------------------------------- running totals


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums along an order: inside ranges of it, from offsets that the ranges' totals give.

    Rows are written to the shared folder once, by ranges, so that no task sees more than one.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    keys = [f"_o{k}" for k in range(len(order))]
    rows = df.withColumns(dict(zip(keys, order, strict=True)) | {f"_s_{k}": c for k, c in sums.items()})
    rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    totals = sorted(rows.groupBy("_p").agg(*[F.coalesce(F.sum(f"_s_{k}"), F.lit(0)).alias(k) for k in sums]).collect(), key=lambda r: r["_p"])  # a row for each range
    at, starts = {k: 0 for k in sums}, []
    for r in totals:
        starts.append((r["_p"], *(float(at[k]) for k in sums)))
        at = {k: at[k] + r[k] for k in sums}
    before = spark.createDataFrame(starts, "_p int, " + ", ".join(f"`_b_{k}` double" for k in sums))
    along = W.partitionBy("_p").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(F.broadcast(before), "_p").withColumns({k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_s_{k}").over(along), F.lit(0)) for k in sums})
    return out.drop("_p", *keys, *(f"_s_{k}" for k in sums), *(f"_b_{k}" for k in sums))


# ---------------------------------------------------------------- zones and intervals


def zones(cells: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(z0, z1, z2, low, high, n): exact bounds of boxes of any shape."""
    keys = [F.floor(F.col(a) / n).cast("int").alias(f"z{k}") for k, (a, n) in enumerate(zip(("t", "y", "x"), shape, strict=True))]
    v = F.col("v").cast("double")
    return cells.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))


def zone_interval(cells: DataFrame, shape: tuple[int, int, int], lo: float, hi: float) -> DataFrame:
    """The interval of a COUNT that zones of a shape give by their bounds alone."""
    z = zones(cells, shape)
    inside = (F.col("low") > lo) & (F.col("high") <= hi)
    outside = (F.col("high") <= lo) | (F.col("low") > hi)
    return z.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("count_lo"), F.coalesce(F.sum(F.when(~outside, F.col("n"))), F.lit(0)).alias("count_hi"))


def cells_with_errors(store: Store, layer: int | None = None) -> DataFrame:
    """(t, y, x, v, unit, block): decoded values with the error of their unit and of their own block (the unit's where blocks have none)."""
    spec = store.spec
    top = spec.top if layer is None else layer
    rows = store.payload.withColumns({"unit": F.col(f"eps{top}"), "block_e": block_error(spec, top)})
    got = decoded(rows, spec, layer, ("chunk_id", "pos", "valid", "unit", "block_e"))
    exploded = got.select("chunk_id", "pos", "valid", "unit", "block_e", F.posexplode("v").alias("cell", "v"))
    real = F.col("valid").isNull() | (F.getbit("valid", F.col("cell")) == 1)
    return exploded.where(real).select(*[c.alias(a) for a, c in zip("tyx", cell_axes(spec), strict=True)], "v", "unit", F.col("block_e").alias("block"))


def mean_interval(cells: DataFrame, eps: Column, lo: float) -> DataFrame:
    """(n, may, mean_lo, mean_hi): bounds of the originals' mean above lo, where a value v with error eps stands for one in [v - eps, v + eps].

    n values are certainly above, may others possibly. The upper bound is the largest mean of
    the certain values and any of the uncertain ones: those whose upper ends exceed the bound
    itself. It is found by repeating that choice until the mean stands still; every turn is an
    aggregate, and no order is needed. Without values that can be above, both are null.
    """
    v = F.col("v").cast("double")
    rows = cells.select(v.alias("v"), eps.cast("double").alias("e"))
    sure, over = F.col("v") > lo + F.col("e"), F.col("v") > lo - F.col("e")
    may, up = over & ~sure, F.col("v") + F.col("e")
    base = rows.agg(F.count_if(sure).alias("n"), F.count_if(may).alias("may"), F.sum(F.when(sure, up)).alias("up"), F.sum(F.when(sure, F.col("v") - F.col("e"))).alias("down"), F.max(F.when(may, up)).alias("most")).first()
    low = high = None
    if base.n:
        low, high = (base.down + base.may * lo) / (base.n + base.may), base.up / base.n
        while base.may:
            got = rows.where(may & (up > high)).agg(F.count("*").alias("k"), F.coalesce(F.sum(up), F.lit(0.0)).alias("s")).first()
            mean = (base.up + got.s) / (base.n + got.k)
            if not mean > high:
                break
            high = mean
    elif base.may:
        low, high = lo, base.most
    return cells.sparkSession.createDataFrame([(base.n, base.may, low, high)], "n long, may long, mean_lo double, mean_hi double")


def filtered_mean(store: Store, lo: float, blocks: bool = True) -> DataFrame:
    """(count, mean, n, may, mean_lo, mean_hi): COUNT and AVG of decoded values above lo, and intervals of the originals' own, by each block's error or its unit's."""
    cells = cells_with_errors(store)
    hit = F.col("v").cast("double") > lo
    got = cells.agg(F.count_if(hit).alias("count"), F.avg(F.when(hit, F.col("v").cast("double"))).alias("mean"))
    return got.crossJoin(mean_interval(cells, F.col("block" if blocks else "unit"), lo))  # one row each


# ---------------------------------------------------------------- samples


def chunk_bytes(cells: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """(c0, c1, c2, bytes): what each chunk takes compressed, its values' bytes shuffled first."""
    at = [F.floor(F.col(a) / n).cast("int").alias(f"c{k}") for k, (a, n) in enumerate(zip("tyx", chunk, strict=True))]
    rows = cells.select(*at, "t", "y", "x", "v").repartition("c0", "c1", "c2").sortWithinPartitions("c0", "c1", "c2", "t", "y", "x").select("c0", "c1", "c2", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        name, values = None, []

        def size() -> pa.RecordBatch:
            raw = np.concatenate(values).view(np.uint8).reshape(-1, 4).T.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in name] + [pa.array([len(press.compress(raw))], pa.int64())], ["c0", "c1", "c2", "bytes"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            v = batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(v)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if name is not None and tuple(keys[a].tolist()) != name:
                    yield size()
                    values.clear()
                name = tuple(keys[a].tolist())
                values.append(v[a:b])
        if name is not None:
            yield size()

    return rows.mapInArrow(work, "c0 int, c1 int, c2 int, bytes long")


def sampled_mean(cells: DataFrame, sizes: DataFrame, budget: int, chunk: tuple[int, int, int] = (16, 16, 16), y: tuple[int, int] | None = None, x: tuple[int, int] | None = None, seed: int = 1) -> DataFrame:
    """(n, all, bytes, mean, half_width): mean of a box from whole chunks, and the half-width of its 95 % interval.

    Chunks that meet the box come in a seeded random order and are taken as long as the bytes
    taken before are below the budget, two at least. sizes: chunk_bytes(). A ratio estimator
    over the chunks' sums, corrected for a finite number of them.
    """
    for name, ends in (("y", y), ("x", x)):
        if ends:
            cells = cells.where((F.col(name) >= ends[0]) & (F.col(name) < ends[1]))
    at = [F.floor(F.col(a) / n).cast("int").alias(f"c{k}") for k, (a, n) in enumerate(zip("tyx", chunk, strict=True))]
    per = cells.groupBy(*at).agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").cast("double").alias("m")).join(sizes, ["c0", "c1", "c2"])
    ordered = running(per, [F.xxhash64("c0", "c1", "c2", F.lit(seed)), F.col("c0"), F.col("c1"), F.col("c2")], {"used": F.col("bytes"), "k": F.lit(1)})
    picked = ordered.where((F.col("used") - F.col("bytes") < budget) | (F.col("k") <= 2))
    all_n = per.agg(F.count("*").alias("all"))
    base = picked.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), (F.sum("s") / F.sum("m")).alias("mean"), F.avg("m").alias("size"))
    spread = picked.select("s", "m").crossJoin(base.select("n", "mean")).agg((F.sum((F.col("s") - F.col("mean") * F.col("m")) ** 2) / F.greatest(F.max("n") - 1, F.lit(1))).alias("var"))
    row = base.crossJoin(spread).crossJoin(all_n)  # one row each
    half = 1.96 * F.sqrt((1 - F.col("n") / F.col("all")) * F.col("var") / F.col("n")) / F.col("size")
    return row.select("n", "all", "bytes", "mean", half.alias("half_width"))


def regions(shape: tuple[int, int], sizes: tuple[tuple[int, int], ...], n: int, seed: int = 0) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """The whole grid and n random boxes of each size, as half-open ranges of y and x."""
    rng, out = np.random.default_rng(seed), [((0, shape[0]), (0, shape[1]))]
    for h, w in sizes:
        for _ in range(n):
            top, left = int(rng.integers(0, shape[0] - h + 1)), int(rng.integers(0, shape[1] - w + 1))
            out.append(((top, top + h), (left, left + w)))
    return out


# ---------------------------------------------------------------- quantiles

_DIGIT = 16  # bits of a key that a pass settles


def _value_of(key: int) -> float:
    return struct.unpack("<d", struct.pack("<q", key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF))[0]


def quantiles(df: DataFrame, value: Column, qs: list[float]) -> DataFrame:
    """(q, value): exact, by linear interpolation; nulls are left out, NaN is an error.

    Four passes settle 16 bits each of the sortable keys of the ranks that are asked for: a
    pass counts the values by the next bits, within the prefixes that hold a rank, so the
    driver gets at most 65,536 counts for each of these and no task gathers values.
    """
    spark = df.sparkSession
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    total = v.agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("odd")).first()
    if total.odd:
        raise ValueError("quantiles of NaN")
    if not total.n:
        return spark.createDataFrame([(float(q), None) for q in qs], "q double, value double")
    places = [q * (total.n - 1) for q in qs]
    ranks = sorted({min(int(p) + k, total.n - 1) for p in places for k in (0, 1)})
    keys = v.select(sort_key(F.col("v")).alias("key"))
    prefix, below = dict.fromkeys(ranks, 0), dict.fromkeys(ranks, 0)
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        known = F.shiftright("key", shift + _DIGIT) if shift + _DIGIT < 64 else F.lit(0).cast("long")
        rows = keys.where(known.isin(sorted(set(prefix.values())))) if shift + _DIGIT < 64 else keys
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.groupBy(known.alias("p"), F.shiftright("key", shift).alias("d")).count().collect():
            counts.setdefault(r.p, []).append((r.d, r["count"]))
        for rank in ranks:
            for d, n in sorted(counts[prefix[rank]]):
                if rank < below[rank] + n:
                    prefix[rank] = d
                    break
                below[rank] += n
    at = {r: _value_of(prefix[r]) for r in ranks}
    out = []
    for q, p in zip(qs, places, strict=True):
        low, high = at[int(p)], at[min(int(p) + 1, total.n - 1)]
        out.append((float(q), low + (high - low) * (p - int(p))))
    return spark.createDataFrame(out, "q double, value double")


def thresholds(cells: DataFrame, selectivities: tuple[float, ...]) -> DataFrame:
    """(selectivity, threshold, true_count): the value that a share of all exceeds, and how many do; one more pass counts them all."""
    v = F.col("v").cast("double")
    cuts = [r.value for r in quantiles(cells, v, [1 - s for s in selectivities]).collect()]
    n = cells.agg(*[F.count_if(v > F.lit(c)).alias(f"n{k}") for k, c in enumerate(cuts)]).first()
    return cells.sparkSession.createDataFrame([(float(s), c, n[k]) for k, (s, c) in enumerate(zip(selectivities, cuts, strict=True))], "selectivity double, threshold double, true_count long")


def group_quantiles(df: DataFrame, keys: list[str], value: str, qs: tuple[float, ...]) -> DataFrame:
    """(keys..., n, q, value): exact quantiles of each group, by linear interpolation, from ranks over the whole table: a hot group fills many tasks."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    ranked = indexed(rows, [*keys, "_v"], "_i")
    of = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_i").alias("_start"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    asked = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.floor(place(q)).alias("low"), F.ceil(place(q)).alias("high"), (place(q) - F.floor(place(q))).alias("part")) for q in qs])
    asked = of.select(*keys, "n", "_start", F.explode(asked).alias("a")).select(*keys, "n", "a.q", "a.part", (F.col("_start") + F.col("a.low")).alias("_low"), (F.col("_start") + F.col("a.high")).alias("_high"))
    at = lambda name: ranked.select(F.col("_i").alias(name), F.col("_v").alias(f"{name}_v"))
    both = asked.join(at("_low"), "_low").join(at("_high"), "_high")
    return both.select(*keys, "n", "q", (F.col("_low_v") + (F.col("_high_v") - F.col("_low_v")) * F.col("part")).alias("value"))


_SPREAD = {0.25: "p25", 0.5: "median", 0.75: "p75", 0.95: "p95", 1.0: "most"}


def spread(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., n, p25, median, p75, p95, most) of each group."""
    q = group_quantiles(runs, keys, value, tuple(_SPREAD))
    return q.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("q") == k, F.col("value"))).alias(name) for k, name in _SPREAD.items()])


def report(runs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys..., measure, n, p25, median, p75, p95, most): spread() of several columns at once."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("_m")) for m in measures])
    long = runs.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.measure", "p._m")
    return spread(long, [*keys, "measure"], "_m")


# ---------------------------------------------------------------- statistics of runs


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of a share, within [0, 1]; null for no trials."""
    p, m = k / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0))
    centre, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.greatest((centre - half) / (1 + z * z / m), F.lit(0.0)), F.least((centre + half) / (1 + z * z / m), F.lit(1.0))


def count_error(count: Column, truth: Column) -> Column:
    """|count - truth| / truth; 0 if the truth is 0."""
    return F.coalesce(F.abs(count - truth) / F.nullif(truth, F.lit(0)), F.lit(0.0))


def read_fraction(maybe: Column, total: Column) -> Column:
    """The share of blocks that were read; null of none."""
    return maybe / F.nullif(total, F.lit(0))


def repay(build: Column, scan: Column, query: Column) -> Column:
    """Queries after which building an index has paid; null if they save nothing."""
    return F.when(scan > query, build / F.nullif(scan - query, F.lit(0.0)))


def overhead(n: Column, rate: Column, dims: int = 3) -> Column:
    """Zone-map bytes over payload bytes of a unit of n blocks."""
    return (12 + 2 * n) / (n * 4**dims * rate / 8)


def wind_speed(u: Column, v: Column) -> Column:
    """sqrt(u^2 + v^2) in double, as a float."""
    return F.sqrt(u.cast("double") ** 2 + v.cast("double") ** 2).cast("float")


def p_faster(runs: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """P(x < y) + P(x = y) / 2 for x of group a and y of group b, by running counts of equal values: no pairs are made."""
    of = lambda g: F.count_if(F.col(group) == g).cast("double")
    n = runs.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("_v")).agg(of(a).alias("na"), of(b).alias("nb"))
    above = running(n, [-F.col("_v").cast("double")], {"upto": F.col("nb")})
    won = F.col("na") * (F.col("upto") - F.col("nb") / 2)
    return above.agg((F.sum(won) / F.nullif(F.sum("na") * F.sum("nb"), F.lit(0.0))).alias("p_faster"))


def resampled_medians(runs: DataFrame, group: str, value: str, resamples: int = 2000, seed: int = 3) -> DataFrame:
    """(group, k, n, median): medians of resamples of each group with as many rows, drawn with replacement.

    A resample's sorted draws are order statistics of uniform numbers, so the ranks around its
    median are drawn outright (from Beta distributions) and looked up among the group's sorted
    values: no row is copied, and equal values are rows of their own. The driver draws
    2 * resamples ranks for each group.
    """
    spark = runs.sparkSession
    rows = runs.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v")).where("g is not null and v is not null")
    ranked = indexed(rows, ["g", "v"])
    of = sorted((r.g, r.n, r.start) for r in ranked.groupBy("g").agg(F.count("*").alias("n"), F.min("i").alias("start")).collect())
    picks = []
    for place, (g, n, start) in enumerate(of):
        rng, k = np.random.default_rng((seed, place)), (n + 1) // 2
        low = rng.beta(k, n + 1 - k, resamples)
        high = low if n % 2 else low + (1 - low) * rng.beta(1, n - k, resamples)
        ranks = [np.minimum((n * u).astype(np.int64), n - 1) + start for u in (low, high)]
        picks += [(g, j, n, int(a), int(b)) for j, (a, b) in enumerate(zip(*ranks, strict=True))]
    asked = spark.createDataFrame(picks, "g string, k long, n long, low long, high long")
    at = lambda name: ranked.select(F.col("i").alias(name), F.col("v").alias(f"{name}_v"))
    found = asked.join(at("low"), "low").join(at("high"), "high")
    return found.select(F.col("g").alias(group), "k", "n", ((F.col("low_v") + F.col("high_v")) / 2).alias("median"))


def best_ratio(runs: DataFrame, group: str, value: str, baselines: list[str], ours: str, resamples: int = 2000, seed: int = 3) -> DataFrame:
    """(ratio, low, high): the smallest of the baselines' medians over ours, and its 95 % bootstrap interval.

    Every resample redraws all groups and picks the fastest baseline anew. The interval is
    null if a group has fewer than two rows or a resample's median of ours is 0.
    """
    whole = spread(runs.where(F.col(group).isin(*baselines, ours)), [group], value).select(F.col(group).alias("g"), "n", "median")
    point = whole.agg(F.try_divide(F.min(F.when(F.col("g").isin(baselines), F.col("median"))), F.max(F.when(F.col("g") == ours, F.col("median")))).alias("ratio"), F.min("n").alias("fewest"))
    medians = resampled_medians(runs.where(F.col(group).isin(*baselines, ours)), group, value, resamples, seed)
    per = medians.groupBy("k").agg(F.try_divide(F.min(F.when(F.col(group).isin(baselines), F.col("median"))), F.max(F.when(F.col(group) == ours, F.col("median")))).alias("r"))
    ends = per.agg(F.sort_array(F.collect_list("r")).alias("r"))  # as many as there are resamples
    at = lambda k: F.when((F.col("fewest") >= 2) & (F.size("r") == resamples), F.get("r", F.lit(k)))
    return point.crossJoin(ends).select("ratio", at(int(0.025 * resamples)).alias("low"), at(int(0.975 * resamples) - 1).alias("high"))


def bootstrap_ratio(runs: DataFrame, group: str, value: str, a: str, b: str, resamples: int = 2000, seed: int = 3) -> DataFrame:
    """(ratio, low, high): the median of group a over that of b, and its 95 % bootstrap interval."""
    return best_ratio(runs, group, value, [a], b, resamples, seed)


# ---------------------------------------------------------------- a tolerance as accurate as a store


def tolerance_search(store: Store, cells: DataFrame, tolerance: float, selectivities: tuple[float, ...] = (0.01, 0.1, 0.5), halvings: int = 16) -> DataFrame:
    """(tolerance, count_error, ok): tolerance / 2^k for k = 0, 1, ... until fixed-accuracy coding counts as well as the store at every threshold.

    Counts above the thresholds of thresholds() are compared with the true ones; the last row
    is the one that passes. Raises if none does.
    """
    spark, spec = cells.sparkSession, store.spec
    cuts = thresholds(cells, selectivities).collect()
    above = lambda rows: rows.agg(*[F.count_if(F.col("v").cast("double") > c.threshold).alias(f"n{k}") for k, c in enumerate(cuts)]).first()
    wrong = lambda got: [abs(g - c.true_count) / c.true_count if c.true_count else 0.0 for g, c in zip(got, cuts, strict=True)]
    ours = wrong(above(cells_of(store, decoded(store.payload, spec))))
    blocks, tried = blocks_of(cells, spec).select("v"), []
    for k in range(halvings + 1):
        step = tolerance / 2**k

        def work(batches: Iterator[pa.RecordBatch], step: float = step) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, 64)
                real = np.isfinite(x)
                low = np.where(real, x, np.inf).min(axis=1)
                back = codec.at_tolerance(np.where(real, x, low[:, None]), step)
                yield pa.RecordBatch.from_arrays([pa.array(back[real])], ["v"])

        got = wrong(above(blocks.mapInArrow(work, "v float")))
        tried.append((step, got, all(g <= o for g, o in zip(got, ours, strict=True))))
        if tried[-1][2]:
            return spark.createDataFrame(tried, "tolerance double, count_error array<double>, ok boolean")
    raise RuntimeError(f"no tolerance down to {step:g} counts as well")
