import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.functions import codec
from gridstone.functions.bounds import next_single_below, range_bounds
from gridstone.operators import explore, query
from gridstone.plans import planner
from gridstone.plans.spec import ArraySpec
from gridstone.sources import store as st
from gridstone.sources.counting import measured

SHAPE = (16, 16, 16)


def field(seed=0, shape=SHAPE):
    t, y, x = np.meshgrid(*map(np.arange, shape), indexing="ij")
    noise = np.random.default_rng(seed).standard_normal(shape)
    return (280 + 10 * np.sin(x / 5) + 8 * np.cos(y / 3) + 3 * np.sin(t / 7) + 0.1 * noise).astype(np.float32)


def cells(spark, a):
    rows = [(int(t), int(y), int(x), float(a[t, y, x])) for t, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "t int, y int, x int, v float")


@pytest.fixture(scope="module")
def lossy(spark):
    a = field()
    return a, st.create(cells(spark, a), ArraySpec(SHAPE, SHAPE, (8, 8, 8), rate=4.0))


def values_of(store):
    return np.array([r.v for r in query.cells_of(store, st.decoded(store.payload, store.spec)).orderBy("t", "y", "x").collect()], np.float32)


def test_codec_is_exact_for_integers_and_prefixes_are_lower_rates():
    a = np.random.default_rng(1).integers(1, 51, (200, 64)).astype(np.float32)
    assert (codec.decode(codec.encode(a, 24)) == a).all()
    smooth = field().reshape(-1, 64)
    whole = codec.encode(smooth, 12)
    errors = []
    for rate in (2, 4, 8, 12):
        assert (whole[:, : 8 * rate] == codec.encode(smooth, rate)).all()
        errors.append(np.abs(codec.decode(whole[:, : 8 * rate]) - smooth).max())
    assert errors == sorted(errors, reverse=True)


@pytest.mark.parametrize("scale", [1e-38, 1e-30, 1.0, 1e30, 3e36])
def test_codec_extremes(scale):
    a = (np.random.default_rng(2).standard_normal((50, 64)) * scale).astype(np.float32)
    a[0], a[1, 1:] = 0, 0
    back = codec.decode(codec.encode(a, 32))
    assert (back[0] == 0).all()
    assert np.abs(back - a).max() <= np.abs(a).max() * 1e-6


def test_codec_rejects_what_is_not_finite():
    with pytest.raises(ValueError):
        codec.encode(np.full((1, 64), np.nan, np.float32), 8)


def test_bounds():
    assert range_bounds(25, None, True)[0] == next_single_below(25) < 25
    assert range_bounds(None, 10, False, False) == (-math.inf, next_single_below(10))
    single = np.float32
    for x in (0.0, -0.0, 1.0, 0.1, -0.1, 25.0, 1e-45, -1e-45, 2.0**-126, -1e30, 3.4e38, 1e39, -1e39, math.inf, 16777217.0):
        with np.errstate(over="ignore"):
            near = single(x)
        want = near if not math.isinf(near) and float(near) < x else np.nextafter(near, single(-math.inf))
        assert next_single_below(x) == float(want), x
    assert next_single_below(-math.inf) == -math.inf
    for bad in ((float("nan"), 1), (2, 1)):
        with pytest.raises(ValueError):
            range_bounds(*bad)


@pytest.mark.parametrize("change", [{"rate": 0}, {"rate": 0.3}, {"layers": (4, 2, 8)}, {"layers": (2, 4)}, {"block_order": (0, 0, 1)}, {"sub_chunk": (6, 4, 4)}, {"block_error_bits": 3}, {"block_error_bits": 4, "layers": (4, 8)}, {"chunk": (10, 16, 16)}, {"shape": (20, 16, 16)}])
def test_spec_checks(change):
    with pytest.raises(ValueError):
        ArraySpec(**({"shape": SHAPE, "rate": 8.0} | change))


def test_spec_round_trip():
    spec = ArraySpec(SHAPE, layers=(2, 8), rate=8)
    assert ArraySpec.from_json(spec.to_json()) == spec
    with pytest.raises(TypeError):
        ArraySpec.from_json("[]")


@pytest.mark.parametrize("q", [0.001, 0.3, 0.9, 0.999])
def test_count_equals_brute_force_on_decoded_values(lossy, q):
    a, store = lossy
    r = values_of(store).astype(np.float64)
    for lo, hi in ((float(np.quantile(a, q)), math.inf), (-math.inf, float(np.quantile(a, q))), (float(np.quantile(a, q / 2)), float(np.quantile(a, q)))):
        row, read = query.count(store, lo, hi).first(), query.accounting(store, lo, hi).first()
        assert row["count"] == ((r > lo) & (r <= hi)).sum()
        assert row.in_blocks + row.out_blocks + row.maybe_blocks == row.total_blocks == 64
        assert read.useful_payload_bytes + read.payload_overread_bytes == read.payload_bytes_read
        assert read.useful_payload_bytes == row.maybe_blocks * 32 and read.bytes_read == read.payload_bytes_read + read.metadata_bytes_read


def originals(spark, a, store):
    """{pos: the 64 original values} of an array of one chunk."""
    return {r.pos: r.v for r in st.blocks_of(cells(spark, a), store.spec).collect()}


def test_states_hold_for_originals_and_decoded_values(lossy, spark):
    a, store = lossy
    lo, hi = (float(x) for x in np.quantile(a, [0.3, 0.6]))
    states = {r.pos: r.state for r in planner.classified(store.zone_map, store.spec, lo, hi).collect()}
    both = [{r.pos: r.v for r in st.decoded(store.payload, store.spec).collect()}, originals(spark, a, store)]
    for blocks in both:
        for pos, v in blocks.items():
            met = [lo < x <= hi for x in v]
            assert states[pos] == 2 or all(met) == any(met) == bool(states[pos])


def test_aggregate_intervals_hold_the_originals(lossy):
    a, store = lossy
    r, a = values_of(store).astype(np.float64), a.astype(np.float64)
    for lo, hi in ((285.0, math.inf), (270.0, 275.5), (1000.0, math.inf)):
        (row, blocks), met, own = ((lambda x: (x[0].first(), x[1].collect()))(query.aggregate(store, lo, hi, return_blocks=True))), (r > lo) & (r <= hi), (a > lo) & (a <= hi)
        assert row["count"] == met.sum() and row["sum"] == pytest.approx(r[met].sum())
        assert row.original_count_lo <= own.sum() <= row.original_count_hi
        assert row.original_sum_lo <= a[own].sum() <= row.original_sum_hi
        assert len(blocks) == row.in_blocks + row.maybe_blocks and blocks == sorted(blocks)
        if own.any():
            assert row.original_mean_lo <= a[own].mean() <= row.original_mean_hi
        else:
            assert row["mean"] is None or met.any()


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 2, 0), (2, 0, 1)])
def test_layers_units_and_orders_give_the_same_values(spark, order):
    shape = (16, 16, 32)
    a = field(3, shape)
    plain = values_of(st.create(cells(spark, a), ArraySpec(shape, (16, 16, 16), rate=8))).reshape(shape)
    assert np.abs(plain - a).max() < 1
    for more in ({"layers": (2, 8)}, {"sub_chunk": (8, 8, 8)}, {"sub_chunk": (4, 8, 16), "layers": (4, 8)}):
        store = st.create(cells(spark, a), ArraySpec(shape, (16, 16, 16), rate=8, block_order=order, **more))
        assert (values_of(store).reshape(shape) == plain).all()
        pts = spark.createDataFrame([(3, 17), (15, 31)], "y int, x int")
        got = {(r.t, r.y, r.x): r.v for r in query.point_series(store, pts).collect()}
        assert got == {(t, y, x): float(plain[t, y, x]) for t in range(16) for y, x in ((3, 17), (15, 31))}


def test_a_padded_array_counts_its_own_values_only(spark):
    """5,000 values in chunks of 4,096: the rest of the second chunk isn't there."""
    rng = np.random.default_rng(7)
    a = np.sort(rng.standard_normal(5000) * 100 + 50).astype(np.float32)
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(a)], "k int, v double")
    found, steps, n = st.cells_from_table(rows, F.col("v"), ["k"])
    assert (steps, n) == (32, 5000)
    spec = ArraySpec((steps, 16, 16), (16, 16, 16), (8, 8, 8), rate=6, length=n, block_order=(2, 0, 1))
    store = st.create(found, spec)
    assert store.zone_map.count() == spec.stored_blocks < spec.total_blocks
    r = values_of(store).astype(np.float64)
    assert len(r) == 5000
    for lo, hi in ((0.0, math.inf), (-math.inf, 30.0), (60.0, 200.0), (-1e9, 1e9), (1e8, 1e9)):
        met = (r > lo) & (r <= hi)
        assert query.count(store, lo, hi).first()["count"] == query.full_scan_count(store, lo, hi).first()["count"] == met.sum()
        row, own = query.aggregate(store, lo, hi).first(), a.astype(float)
        own = own[(own > lo) & (own <= hi)]
        assert row["count"] == met.sum() and row.original_count_lo <= len(own) <= row.original_count_hi
        ends = query.count_interval(store, lo, hi).first()
        assert ends.count_lo <= met.sum() <= ends.count_hi and ends.count_lo <= len(own) <= ends.count_hi
    assert query.region(store, (0, 16), (0, 16)).first().n == 5000
    assert query.max_error(store, found).first().held
    with pytest.raises(Exception, match="lacks values"):
        st.create(found.where("t < 19 or y > 2"), spec)


def test_wide_arrays_are_planned_in_buckets(spark, lossy, monkeypatch):
    a, store = lossy
    whole = [query.count(store, lo, hi).first() for lo, hi in ((285.0, math.inf), (270.0, 275.5))]
    monkeypatch.setattr(planner, "MOST_BUCKETS", 5)
    monkeypatch.setattr(planner, "MOST_RANGES", 2)
    monkeypatch.setattr(planner, "TASK_BLOCKS", 1)
    monkeypatch.setattr(query, "TASK_BLOCKS", 1)
    assert [query.count(store, lo, hi).first() for lo, hi in ((285.0, math.inf), (270.0, 275.5))] == whole
    assert planner.joined_ranges([(9, 9), (0, 1), (4, 5)], 2) == ((0, 5), (9, 9))
    assert planner.joined_ranges([(0, 1), (2, 3)], 9) == ((0, 3),)


def test_pruned_counts_read_less(spark):
    n = 64 * 4096
    rows = spark.range(n).select((F.col("id") / 256).cast("int").alias("t"), (F.col("id") % 256 / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), (F.col("id") + F.rand(1) * 50).cast("float").alias("v"))
    store = st.create(rows, ArraySpec((1024, 16, 16), (16, 16, 16), (8, 8, 8), rate=12))
    lo = float(n) * 0.99
    one, few = measured(spark, lambda: query.count(store, lo, math.inf).first()["count"])
    two, all_of = measured(spark, lambda: query.full_scan_count(store, lo, math.inf).first()["count"])
    assert one == two and few.bytes_read < all_of.bytes_read / 3


def test_merged_reads(spark):
    blocks = spark.createDataFrame([(0, p) for p in (1, 2, 4, 9, 10, 11)] + [(1, 12)], "chunk_id int, pos int")
    got = {(r.chunk_id, r["first"], r["last"]) for r in planner.merged(blocks, 1).collect()}
    assert got == {(0, 1, 4), (0, 9, 11), (1, 12, 12)}
    split = {(r.chunk_id, r["first"], r["last"]) for r in planner.merged(blocks, 1, 2).collect()}
    assert split == {(0, 1, 2), (0, 4, 4), (0, 9, 10), (0, 11, 11), (1, 12, 12)}


def test_store_opens_and_refuses_another_layout(spark, lossy):
    _, store = lossy
    again = st.open_store(spark, store.folder)
    assert again.spec == store.spec and st.check_meta(again).count() == 0
    with pytest.raises(ValueError):
        again.check_source(ArraySpec(SHAPE))


def test_rejects_missing_doubled_and_infinite_cells(spark):
    rows, infinite = cells(spark, field()), F.when(F.col("x") == 1, F.lit(float("inf"))).otherwise(F.col("v")).cast("float")
    for bad, says in ((rows.where("x > 0"), "lacks values"), (rows.union(rows.limit(1)), "twice"), (rows.where("t > 7"), "lack"), (rows.withColumn("v", infinite), "finite")):
        with pytest.raises(Exception, match=says):
            st.create(bad, ArraySpec(SHAPE, SHAPE, (8, 8, 8)))
    with pytest.raises(TypeError):
        st.create(rows.withColumn("v", F.col("v").cast("double")), ArraySpec(SHAPE))


def test_indexed_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert [(r.i, r.k) for r in st.indexed(df, ["k"]).orderBy("i").collect()] == [(k, k) for k in range(1000)]


def test_p_faster_equals_pairs(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 1.0]
    runs = spark.createDataFrame([("a", v) for v in x] + [("b", v) for v in y], "g string, v double")
    exact = np.mean([1.0 if p < q else 0.5 if p == q else 0.0 for p in x for q in y])
    assert explore.p_faster(runs, "g", "v", "a", "b").first()[0] == pytest.approx(exact)
