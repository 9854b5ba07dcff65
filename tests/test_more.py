"""Options, calls, baselines, Zarr directories, growing arrays and statistics."""

import asyncio
import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridstone
from gridstone import runlog
from gridstone.functions import codec, records
from gridstone.functions.expr import key_value, next_down, next_up, pack_nibbles, sort_key, unpack_nibbles
from gridstone.operators import explore, query
from gridstone.plans import planner
from gridstone.plans.options import QueryOptions
from gridstone.plans.spec import ArraySpec, layout
from gridstone.sources import baseline, zarr
from gridstone.sources import store as st
from gridstone.streaming import slabs
from tests.test_engine import SHAPE, cells, field, values_of


@pytest.fixture(scope="module")
def layered(spark):
    a = field(5)
    return a, st.create(cells(spark, a), ArraySpec(SHAPE, (8, 16, 16), (8, 8, 8), rate=8.0, layers=(2, 4, 8)))


@pytest.fixture(scope="module")
def coded(spark):
    a = field(6)
    return a, st.create(cells(spark, a), ArraySpec(SHAPE, (8, 16, 16), (8, 8, 8), rate=5.0, block_error_bits=4))


# ---------------------------------------------------------------- options and calls


@pytest.mark.parametrize(("name", "bad", "says"), [("threads", -1, "non-negative"), ("request_concurrency", 0, "greater than 0"), ("request_batch_size", 0, "greater than 0"), ("merge_gap_blocks", -1, "non-negative"), ("max_chunk_requests", 0, "greater than 0"), ("max_inflight_bytes", 0, "greater than 0")])
def test_options_are_checked(name, bad, says):
    with pytest.raises(ValueError, match=f"{name} must be {says}"):
        QueryOptions(**{name: bad})


def test_options_never_change_an_answer(spark, layered):
    a, store = layered
    lo = float(np.quantile(a, 0.8))
    for layer in range(3):
        want = gridstone.query_gt(store, lo, options=QueryOptions(layer=layer))
        for more in ({"threads": 2}, {"merge_gap_blocks": 0}, {"merge_gap_blocks": 50}, {"max_chunk_requests": 100}, {"pipeline": False, "zero_copy": False, "meta_by_key": False}, {"request_batch_size": 3}) + (({"max_inflight_bytes": 40},) if not layer else ()):
            got = gridstone.query_gt(store, lo, options=QueryOptions(layer=layer, **more))
            assert got["count"] == want["count"] and got.maybe_blocks == want.maybe_blocks
    assert "planning_seconds" in gridstone.query_gt(store, lo, options=QueryOptions(trace=True))
    for bad in (QueryOptions(layer=3), QueryOptions(max_inflight_bytes=10)):
        with pytest.raises(ValueError):
            gridstone.query_gt(store, lo, options=bad)
    with pytest.raises(ValueError, match="layer 0"):
        gridstone.aggregate_gt(store, lo)
    assert gridstone.aggregate_gt(store, lo, options=QueryOptions(layer=0, max_inflight_bytes=40))["count"] == gridstone.query_gt(store, lo, options=QueryOptions(layer=0))["count"]


def test_calls(spark, coded):
    a, store = coded
    r = values_of(store).astype(float)
    t = float(r[100])
    assert gridstone.query_gt(store, t)["count"] == (r > t).sum() and gridstone.query_gt(store.folder, t, inclusive=True)["count"] == (r >= t).sum()
    assert gridstone.query_lt(store, t)["count"] == (r < t).sum() and gridstone.query_lt(store, t, inclusive=True)["count"] == (r <= t).sum()
    assert gridstone.query_range(store, t, t, lo_inclusive=True)["count"] == (r == t).sum() and gridstone.query_range(store, t, t)["count"] == 0
    row, blocks = gridstone.aggregate_lt(store, t, inclusive=True, return_blocks=True)
    assert row["count"] == (r <= t).sum() and blocks.count() == row.in_blocks + row.maybe_blocks
    assert row.useful_payload_bytes == (row.in_blocks + row.maybe_blocks) * 40 and row.range_requests == row.payload_requests + row.metadata_requests
    assert gridstone.aggregate_range(store, t - 1, t + 1)["sum"] == pytest.approx(r[(r > t - 1) & (r <= t + 1)].sum())
    with pytest.raises(TypeError):
        gridstone.query_range(store, None, 1.0)
    with pytest.raises(ValueError):
        gridstone.query_range(store, 2.0, 1.0)
    assert asyncio.run(gridstone.query_gt_async(store, t))["count"] == (r > t).sum()
    assert asyncio.run(gridstone.query_range_async(store, t - 1, t + 1))["count"] == ((r > t - 1) & (r <= t + 1)).sum()
    with pytest.raises(TypeError):
        asyncio.run(gridstone.query_lt_async(store.folder, t))


def test_opening(spark, coded, tmp_path):
    _, store = coded
    assert gridstone.open_store(spark, store) is store
    assert gridstone.open_store(spark, store.folder.rpartition("/")[0], store.folder.rpartition("/")[2]).spec == store.spec
    for more in ({"array_path": "x"}, {"storage_options": {"a": "b"}}):
        with pytest.raises(ValueError, match="opened array"):
            gridstone.open_store(spark, store, **more)
    with pytest.raises(FileNotFoundError):
        gridstone.open_store(spark, f"{tmp_path}/none")
    (tmp_path / "other").mkdir()
    with pytest.raises(TypeError):
        gridstone.open_store(spark, f"{tmp_path}/other")


def test_an_array_without_a_recorded_source_is_trusted(spark):
    a = field(2)
    store = st.create(cells(spark, a), ArraySpec(SHAPE, SHAPE, rate=8))
    spark.createDataFrame([(ArraySpec(SHAPE, SHAPE, rate=4).to_json(),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{store.folder}/source")
    with pytest.raises(ValueError, match="another layout"):
        gridstone.open_store(spark, store.folder)
    for name in ("source", "chunk_crc"):
        st.delete(spark, f"{store.folder}/{name}")
    assert gridstone.query_gt(store.folder, -1e9)["count"] == 4096
    with pytest.raises(ValueError, match="no zone map source"):
        gridstone.check_meta(store)


def test_layouts():
    assert layout("k8t-b4-z") == ({"rate": 8.0, "sub_chunk": (64, 16, 32), "block_order": (1, 2, 0), "block_error_bits": 4}, True)
    assert layout("k8")[0]["block_order"] == (0, 1, 2)
    with pytest.raises(ValueError):
        layout("k8-x")


# ---------------------------------------------------------------- bytes


@pytest.mark.parametrize("size", [4, 16, 64])
def test_codec_of_each_dimension(size):
    a = (np.random.default_rng(size).standard_normal((80, size)) * 50).astype(np.float32)
    errors = [np.abs(codec.decode(codec.encode(a, r), size) - a).max() for r in (8, 16, 28)]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1e-3
    for tolerance in (10.0, 0.5, 1e-3):
        assert np.abs(codec.at_tolerance(a, tolerance) - a).max() <= tolerance


def test_records_round_trip():
    rng = np.random.default_rng(1)
    for more in ({}, {"layers": (2, 8)}, {"block_error_bits": 4}):
        spec = ArraySpec((16, 16, 16), sub_chunk=(4, 4, 12) if not more else (8, 8, 8), chunk=(16, 16, 12) if not more else (16, 16, 16), **more) if more else ArraySpec((16, 16, 24), (16, 16, 12), (4, 4, 12))
        n, b = 5, spec.blocks_per_unit
        given = {"cmin": rng.standard_normal(n).astype(np.float32), "cmax": rng.standard_normal(n).astype(np.float32), "eps": rng.random((n, len(spec.rates))), "qmin": rng.integers(0, 256, (n, b)), "qmax": rng.integers(0, 256, (n, b))}
        code = rng.integers(0, 16, (n, b)) if spec.block_error_bits else None
        rec = records.records(spec, **given, code=code)
        assert rec.shape == (n, spec.record_bytes)
        for packing in records.PACKINGS:
            assert (records.unpacked(spec, records.packed(spec, rec, packing), packing, n) == rec).all()
        back = records.fields(spec, rec)
        assert (back["eps"] >= given["eps"]).all() and np.allclose(back["eps"], given["eps"], rtol=1e-6)
        assert all((back[k] == given[k]).all() for k in ("cmin", "cmax", "qmin", "qmax")) and (code is None or (back["code"] == code).all())
    with pytest.raises(ValueError, match="unknown packing"):
        records.packed(spec, rec, "lz4")
    with pytest.raises(ValueError, match="layout"):
        records.unpacked(spec, b"123", None)


def test_expressions(spark):
    codes = [[], [3], [1, 2, 3], [15, 0, 15, 15]]
    rows = spark.createDataFrame([(c,) for c in codes], "c array<int>").select("c", pack_nibbles(F.col("c")).alias("p")).select("c", "p", unpack_nibbles(F.col("p"), F.size("c")).alias("back")).collect()
    assert all(r.back == r.c for r in rows) and {tuple(r.c): r.p for r in rows}[(1, 2, 3)] == [0x21, 3]
    values = [0.0, -1.5, 3e38, -3e-39, 1e-300, -1e300, 7.25, math.inf, -math.inf]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", sort_key(F.col("v")).alias("k"), next_up(F.col("v")).alias("u"), next_down(F.col("v")).alias("d")).withColumn("back", key_value(F.col("k"))).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == sorted(values) and all(r.back == r.v for r in got)
    assert all(r.u == math.nextafter(r.v, math.inf) and r.d == math.nextafter(r.v, -math.inf) for r in got)


# ---------------------------------------------------------------- regions


@pytest.mark.parametrize("box", [((2, 13), (5, 16)), ((0, 16), (0, 16)), ((0, 8), (8, 16)), ((3, 4), (3, 4))])
def test_region_bounds_against_numpy(coded, layered, box):
    (y0, y1), (x0, x1) = box
    for (a, store), layer in ((coded, 0), (layered, 0), (layered, 2)):
        exact = a[:, y0:y1, x0:x1].astype(float)
        row = query.region(store, *box, layer).first()
        assert row.n == exact.size
        for kind, true in (("avg", exact.mean()), ("min", exact.min()), ("max", exact.max())):
            for letter in "abc":
                assert abs(row[kind] - true) <= row[f"{kind}_bound_{letter}"] + 1e-9
        assert row.avg_bound_c <= row.avg_bound_b + 1e-12 <= row.avg_bound_a + 1e-9
        ends = query.region_meta_minmax(store, *box).first()
        assert ends.min_lo <= exact.min() <= ends.min_hi and ends.max_lo <= exact.max() <= ends.max_hi
        if box == ((0, 16), (0, 16)):
            assert (ends.min_lo, ends.min_hi, ends.max_lo, ends.max_hi) == (exact.min(), exact.min(), exact.max(), exact.max())


def test_mean_interval_is_the_best_prefix(spark):
    rng = np.random.default_rng(4)
    for lo in (-5.0, 0.0, 0.9, 1.4, 9.0):
        r, e = np.round(rng.random(300), 2), np.round(rng.random(300) * 0.5, 2)
        sure = r > lo + e
        may = (r > lo - e) & ~sure
        row = explore.mean_interval(spark.createDataFrame([(float(a), float(b)) for a, b in zip(r, e)], "v double, e double"), F.col("e"), lo).first()
        assert (row.n, row.may) == (sure.sum(), may.sum())
        if sure.any():
            ups = np.sort((r + e)[may])[::-1]
            best = max([(r + e)[sure].mean(), *(((r + e)[sure].sum() + np.cumsum(ups)) / (sure.sum() + np.arange(1, len(ups) + 1)))])
            assert row.mean_hi == pytest.approx(best) and row.mean_lo == pytest.approx(((r - e)[sure].sum() + may.sum() * lo) / (sure.sum() + may.sum()))
        else:
            assert row.mean_hi == (pytest.approx((r + e)[may].max()) if may.any() else None)


# ---------------------------------------------------------------- baselines


@pytest.mark.parametrize("shard", [None, (16, 16, 16)])
def test_baselines_against_numpy(spark, tmp_path, shard):
    a = field(9, (32, 16, 16))
    rows = cells(spark, a).where("not (t = 20 and y < 4)")  # absent values are met by nothing
    a = a.copy()
    a[20, :4] = np.nan
    store = baseline.write(rows, f"{tmp_path}/b{shard}", a.shape, (8, 8, 4), shard)
    for lo, hi in ((285.0, math.inf), (-math.inf, 265.0), (275.0, 276.0)):
        with np.errstate(invalid="ignore"):
            met = int(((a > lo) & (a <= hi)).sum())
        got = baseline.zone_count(store, lo, hi).first()
        assert got["count"] == met == baseline.full_scan_count(store, lo, hi).first()["count"] and got.zones_read < got.zones
    pts = spark.createDataFrame([(1, 2), (9, 15)], "y int, x int")
    got = {(r.t, r.y, r.x): r.v for r in baseline.point_series(store, pts).collect()}
    assert got == {(t, y, x): float(a[t, y, x]) for t in range(32) for y, x in ((1, 2), (9, 15)) if not np.isnan(a[t, y, x])}
    if shard:
        index = baseline.shard_index(store).collect()
        assert len(index) == 2 * store.n_inner and all(r.size > 0 for r in index)
        bad = spark.read.parquet(f"{store.folder}/data").withColumn("data", F.expr("cast(concat(substr(data, 1, octet_length(data) - 1), X'00') as binary)"))
        bad.write.parquet(f"{tmp_path}/bad/data")
        with pytest.raises(Exception, match="damaged"):
            baseline.shard_index(baseline.Chunked(spark, f"{tmp_path}/bad", store.shape, store.chunk, shard)).collect()


def test_tolerance_search_counts_as_well_as_the_store(spark, coded):
    a, store = coded
    tried = explore.tolerance_search(store, cells(spark, a), 64.0, (0.1, 0.5)).collect()
    assert tried[-1].ok and not any(r.ok for r in tried[:-1]) and [r.tolerance for r in tried] == [64 / 2**k for k in range(len(tried))]
    r = values_of(store).astype(float)
    for k, s in enumerate((0.1, 0.5)):
        cut = np.quantile(a.astype(float), 1 - s)
        true = (a.astype(float) > cut).sum()
        assert tried[-1].count_error[k] <= abs((r > cut).sum() - true) / true


# ---------------------------------------------------------------- Zarr


@pytest.mark.parametrize("packing", [None, "planar-zstd"])
@pytest.mark.parametrize("more", [{}, {"layers": (2, 8)}, {"block_error_bits": 4, "block_order": (1, 2, 0)}])
def test_zarr_round_trip(spark, tmp_path, packing, more):
    a = field(8, (32, 16, 16))
    store = st.create(cells(spark, a), ArraySpec(a.shape, (16, 16, 16), (8, 8, 8), rate=8, **more))
    folder = f"{tmp_path}/group"
    zarr.save(zarr.objects(store, packing=packing), folder)
    back = zarr.read(spark, folder)
    assert back.spec.rates == store.spec.rates and (values_of(back) == values_of(store)).all()
    names = ["block", "unit_id", "cmin", "cmax", "qmin", "qmax"]
    assert sorted(back.zone_map.select(names).collect()) == sorted(store.zone_map.select(names).collect())
    lo = float(np.quantile(a, 0.7))
    assert query.count(back, lo, math.inf).first()["count"] == query.count(store, lo, math.inf).first()["count"]
    assert st.check_meta(back).count() == 0


def test_zarr_damage(spark, tmp_path):
    a = field(8)
    store = st.create(cells(spark, a), ArraySpec(SHAPE, (8, 16, 16), (8, 8, 8), rate=8))
    found = zarr.objects(store)

    def fresh(name):
        folder = tmp_path / name
        zarr.save(found, str(folder))
        return folder

    def rewrite(path, data):
        path.write_bytes(data)
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)  # the local file system's own checksum

    folder = fresh("a")
    (folder / "data/c/1/0/0").unlink()
    with pytest.raises(FileNotFoundError):
        zarr.read(spark, str(folder))
    folder = fresh("b")
    rewrite(folder / "data_meta/c/0/0/0/0", b"short")
    with pytest.raises(Exception, match="doesn't match the layout"):
        zarr.read(spark, str(folder))
    for name, change, says in (("c", {"zones_meta_packing": "lz4"}, "unknown packing"), ("d", {"zones_meta": None}, "no zone map"), ("e", {"zones_meta_source": {"codec": {}, "shape": [1], "chunks": [1]}}, "another layout")):
        folder = fresh(name)
        document = json.loads((folder / "data/zarr.json").read_text())
        document["attributes"] |= change
        rewrite(folder / "data/zarr.json", json.dumps(document).encode())
        with pytest.raises(ValueError, match=says):
            zarr.read(spark, str(folder))
    folder = fresh("f")
    document = json.loads((folder / "data/zarr.json").read_text())
    for key in ("zones_meta_source", "zones_meta_t_chunk"):
        document["attributes"].pop(key)
    rewrite(folder / "data/zarr.json", json.dumps(document).encode())
    assert query.count(zarr.read(spark, str(folder)), 0.0, math.inf).first()["count"] == 4096  # an old array: trusted


# ---------------------------------------------------------------- growing arrays


def test_slabs_are_appended_and_replaced(spark, tmp_path):
    a = field(11, (48, 16, 16))
    spec, folder = ArraySpec((16, 16, 16), (16, 16, 16), (8, 8, 8), rate=8, folder_chunks=1), f"{tmp_path}/grown"
    rows = cells(spark, a)
    for k in range(3):
        rows.where(f"t div 16 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("t int, y int, x int, v float").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    slabs.follow(stream, folder, spec, f"{tmp_path}/checkpoint").awaitTermination()
    store = gridstone.open_store(spark, folder)
    whole = st.create(rows, ArraySpec(a.shape, (16, 16, 16), (8, 8, 8), rate=8))
    assert store.spec.shape == a.shape and (values_of(store) == values_of(whole)).all() and gridstone.check_meta(store).count() == 0
    again = slabs.append(folder, store.spec, rows.where("t between 16 and 31").withColumn("v", (F.col("v") + 100).cast("float")))
    assert again.shape == a.shape and query.count(gridstone.open_store(spark, folder), 350.0, math.inf).first()["count"] == 4096
    with pytest.raises(Exception, match="lack"):
        slabs.append(folder, again, rows.where("t between 16 and 31 and y > 3"))
    with pytest.raises(ValueError, match="folder_chunks"):
        slabs.append(folder, ArraySpec((16, 16, 16)), rows)


# ---------------------------------------------------------------- statistics


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500), np.full(300, 2.5), [0.0, -0.0]])
    qs = [0.0, 0.01, 0.333, 0.5, 0.77, 1.0]
    got = explore.quantiles(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), F.col("v"), qs).collect()
    assert [r.value for r in got] == pytest.approx(np.quantile(values, qs).tolist())
    assert [r.value for r in explore.quantiles(spark.createDataFrame([], "v double"), F.col("v"), [0.5]).collect()] == [None]
    with pytest.raises(ValueError):
        explore.quantiles(spark.createDataFrame([(math.nan,)], "v double"), F.col("v"), [0.5])
    parts = explore.spread(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("b", 7.0), ("c", None)], "g string, v double"), ["g"], "v")
    assert {r.g: (r.n, r.p25, r.median, r.p75, r.p95, r.most) for r in parts.collect()} == {"a": (3, 1.5, 2.0, 3.0, pytest.approx(3.8), 4.0), "b": (2, 7.0, 7.0, 7.0, 7.0, 7.0)}


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(int(k), float(v)) for k, v in zip(rng.permutation(500), rng.random(500))], "k int, v double")
    got = sorted((r.k, r.v, r.s) for r in explore.running(rows, [F.col("k")], {"s": F.col("v")}).collect())
    assert [s for _, _, s in got] == pytest.approx(np.cumsum([v for _, v, _ in got]).tolist())


def test_bootstrap_of_medians(spark):
    """Equal values are rows of their own; the interval agrees with one from plain resampling."""
    rng = np.random.default_rng(8)
    same = spark.createDataFrame([("a", 3.0)] * 100 + [("b", 1.5)] * 101, "g string, v double")
    assert explore.bootstrap_ratio(same, "g", "v", "a", "b").first() == (2.0, 2.0, 2.0)
    for na, nb in ((30, 31), (200, 45)):
        a, b = np.round(rng.lognormal(0, 0.5, na), 2), np.round(rng.lognormal(0.3, 0.7, nb), 2)
        runs = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 1e9)], "g string, v double")
        row = explore.bootstrap_ratio(runs, "g", "v", "a", "b", 4000).first()
        plain = np.sort(np.median(rng.choice(a, (20000, na)), axis=1) / np.median(rng.choice(b, (20000, nb)), axis=1))
        assert row.ratio == pytest.approx(np.median(a) / np.median(b))
        assert row.low == pytest.approx(np.quantile(plain, 0.025), rel=0.06) and row.high == pytest.approx(np.quantile(plain, 0.975), rel=0.06)
    few = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert explore.bootstrap_ratio(few, "g", "v", "a", "b").first()[1:] == (None, None)


def test_best_ratio_takes_the_fastest_baseline(spark):
    times = {"x": [5.0, 6.0, 7.0], "y": [3.0, 4.0, 9.0], "ours": [2.0, 2.0, 2.0]}
    runs = spark.createDataFrame([(g, v) for g, vs in times.items() for v in vs], "g string, v double")
    row = explore.best_ratio(runs, "g", "v", ["x", "y"], "ours").first()
    assert row.ratio == 2.0 and row.low == 1.5 and 2.5 <= row.high <= 3.5


def test_medians_of_resamples_have_the_right_spread(spark):
    values = np.arange(1, 42, dtype=float)
    got = explore.resampled_medians(spark.createDataFrame([("a", float(v)) for v in values], "g string, v double"), "g", "v", 4000).toPandas()["median"]
    plain = np.median(np.random.default_rng(1).choice(values, (20000, 41)), axis=1)
    assert abs(got.mean() - plain.mean()) < 0.4 and abs(got.std() - plain.std()) < 0.3 and len(got) == 4000


def test_sample_takes_the_chunk_that_crosses_the_budget(spark):
    a = field(12, (64, 16, 16))
    rows = cells(spark, a)
    sizes = explore.chunk_bytes(rows, (16, 16, 16))
    each = [r.bytes for r in sizes.collect()]
    assert len(each) == 4 and all(0 < b < 4 * 4096 for b in each)
    one = explore.sampled_mean(rows, sizes, 1).first()
    assert one.n == 2 and one["all"] == 4  # two at least
    three = explore.sampled_mean(rows, sizes, sorted(each)[0] * 2 + 1).first()
    assert three.n in (2, 3) and three.bytes >= sorted(each)[0] * 2 + 1
    whole = explore.sampled_mean(rows, sizes, 1 << 40, y=(2, 9), x=(0, 5)).first()
    assert whole.n == 4 and whole.mean == pytest.approx(a[:, 2:9, :5].astype(float).mean()) and whole.half_width == 0


def test_regions_and_scalars(spark):
    boxes = explore.regions((128, 256), ((32, 32), (4, 4)), 20, seed=3)
    assert len(boxes) == 41 and boxes == explore.regions((128, 256), ((32, 32), (4, 4)), 20, seed=3)
    assert all(0 <= y0 < y1 <= 128 and 0 <= x0 < x1 <= 256 for (y0, y1), (x0, x1) in boxes)
    row = spark.range(1).select(explore.count_error(F.lit(5), F.lit(0)).alias("a"), explore.count_error(F.lit(5), F.lit(4)).alias("b"), explore.repay(F.lit(10.0), F.lit(1.0), F.lit(2.0)).alias("c"), explore.repay(F.lit(10.0), F.lit(3.0), F.lit(1.0)).alias("d"), explore.read_fraction(F.lit(1), F.lit(0)).alias("e"), explore.overhead(F.lit(512), F.lit(8.0), 2).alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (0.0, 0.25, None, 5.0, None) and row.f == pytest.approx(1036 / (512 * 16))


def test_slab_ranges_cover_all(spark):
    rows = cells(spark, field(1, (48, 16, 16)))
    parts = [p.agg(F.min("t"), F.max("t"), F.count("*")).first() for p in st.slabs(rows, 48, 32)]
    assert [tuple(p) for p in parts] == [(0, 31, 32 * 256), (32, 47, 16 * 256)]


def test_gap_default():
    assert planner.gap_blocks(64) == 4000 and planner.gap_blocks(64, 0) == 0


def test_run_log(tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data/x").write_text("1")
    log = runlog.RunLog(f"{tmp_path}/runs.jsonl", f"{tmp_path}/data", name="t")
    log.add(query="a", seconds=1.5)
    other = runlog.RunLog(f"{tmp_path}/runs.jsonl")
    other.add(query="b", seconds=2.5)
    assert [r["query"] for r in runlog.read(f"{tmp_path}/runs.jsonl")] == ["a", "b"]
    assert [r["query"] for r in runlog.read(f"{tmp_path}/runs.jsonl", log.run_id)] == ["a"]
    first = json.loads((tmp_path / "runs.jsonl").read_text().splitlines()[0])
    assert first["provenance"]["name"] == "t" and first["provenance"]["data_digest"] == runlog.fingerprint(f"{tmp_path}/data")


def test_medians_match_the_standard_library(spark):
    values = [5.0, 1.0, 4.0, 4.0]
    runs = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    assert explore.spread(runs, ["g"], "v").first().median == statistics.median(values)
