"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.functions.bounds import range_bounds
from gridstone.functions.expr import in_range, key_value, pack_nibbles, sort_key, unpack_nibbles
from gridstone.operators import explore, query, sweep
from gridstone.plans import planner
from gridstone.plans.options import QueryOptions
from gridstone.plans.spec import ArraySpec
from gridstone.sources import baseline, zarr
from gridstone.sources import store as st

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
FIXTURES = {
    "QTY": ("lineitem", "cast(l_quantity as float)", KEY, "CAST(l_quantity AS FLOAT)"),
    "QTYS": ("lineitem", "cast(l_quantity as float)", ["l_quantity", *KEY], "CAST(l_quantity AS FLOAT)"),
    "DAY": ("lineitem", "cast(datediff(cast(l_shipdate as date), date'1992-01-01') as float)", ["l_shipdate", *KEY], "CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS FLOAT)"),
    "PRICE": ("lineitem", "cast(l_extendedprice as float)", KEY, "CAST(l_extendedprice AS FLOAT)"),
    "PRICES": ("lineitem", "cast(l_extendedprice as float)", ["l_extendedprice", *KEY], "CAST(l_extendedprice AS FLOAT)"),
}
_cells: dict = {}
_stores: dict = {}
_baselines: dict = {}


def cells(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, int, int]:
    """(t, y, x, v) of all of a fixture's rows, the steps of its array and the number of rows; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _cells:
        if name == "EMB":  # a vector is a block
            rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("j", "e"))
            found = st.cells_from_table(rows, F.col("e"), ["vec_id", "j"], width=(4, 4))
        else:
            table, value, order, _ = FIXTURES[name]
            found = st.cells_from_table(spark.read.parquet(f"{sf_dir}/{table}.parquet"), F.expr(value), order)
        folder = f"{st.shared_folder(spark)}/cells-{name}-{uuid.uuid4().hex}"
        found[0].write.parquet(folder)
        _cells[key] = (folder, *found[1:])
    folder, steps, n = _cells[key]
    return spark.read.parquet(folder), steps, n


def store(spark: SparkSession, sf_dir: str, name: str, rate: float = 24, **more) -> st.Store:
    """The store of a fixture; built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, rate, *sorted(more.items()))
    if key not in _stores:
        found, steps, n = cells(spark, sf_dir, name)
        spec = ArraySpec((steps, 4, 4), (16, 4, 4), rate=rate, length=n, **more) if name == "EMB" else ArraySpec((steps, 16, 16), (16, 16, 16), (8, 8, 8), rate=rate, length=n, **more)
        _stores[key] = st.create(found, spec)
    return _stores[key]


def chunked(spark: SparkSession, sf_dir: str, name: str, chunk: tuple[int, int, int], shard: tuple[int, int, int] | None = None, **more) -> baseline.Chunked:
    """A fixture as compressed chunks or shards; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, chunk, shard, *sorted(more.items()))
    if key not in _baselines:
        found, steps, _ = cells(spark, sf_dir, name)
        _baselines[key] = baseline.write(found, f"{st.shared_folder(spark)}/chunks-{uuid.uuid4().hex}", (steps, 16, 16), chunk, shard, **more)
    return _baselines[key]


# ---------------------------------------------------------------- SQL of the planner


def _number(x: float) -> str:
    return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)" if math.isinf(x) else f"CAST({x!r} AS DOUBLE)"


def _cells_sql(name: str) -> str:
    table, _, order, value = FIXTURES[name]
    return f"""o AS (SELECT CAST({value} AS DOUBLE) v, row_number() OVER (ORDER BY {', '.join(order)}) - 1 i FROM {table}),
c AS (SELECT v, CAST(floor(i / 256) AS BIGINT) t, CAST(floor((i % 256) / 16) AS BIGINT) y, i % 16 x FROM o)"""


def _blocks_sql(name: str, rank: str = "CAST(floor((t % 8) / 4) * 4 + floor((y % 8) / 4) * 2 + floor((x % 8) / 4) AS BIGINT)") -> str:
    return _cells_sql(name) + f""",
b AS (SELECT CAST(floor(t / 16) AS BIGINT) chunk_id, CAST(floor(t / 8) * 4 + floor(y / 8) * 2 + floor(x / 8) AS BIGINT) unit_id,
  CAST(floor((t % 16) / 8) * 4 + floor(y / 8) * 2 + floor(x / 8) AS BIGINT) * 8 + {rank} pos, min(v) bmin, max(v) bmax, count(*) n,
  min(floor(y / 4)) fy, min(floor(x / 4)) fx FROM c GROUP BY 1, 2, 3),
u AS (SELECT *, min(bmin) OVER (PARTITION BY unit_id) cmin, max(bmax) OVER (PARTITION BY unit_id) cmax FROM b),
q AS (SELECT *, CASE WHEN cmax = cmin THEN 0 ELSE least(greatest(floor((bmin - cmin) * (CAST(255 AS DOUBLE) / (cmax - cmin))), 0), 255) END qmin,
  CASE WHEN cmax = cmin THEN 0 ELSE least(greatest(ceil((bmax - cmin) * (CAST(255 AS DOUBLE) / (cmax - cmin))), 0), 255) END qmax FROM u),
w AS (SELECT *, CASE WHEN cmax = cmin THEN cmin ELSE cmin + (qmin / CAST(255 AS DOUBLE)) * (cmax - cmin) - 8 * CAST(2.220446049250313e-16 AS DOUBLE) * (abs(cmin) + abs(cmax)) END lo_b,
  CASE WHEN cmax = cmin THEN cmin ELSE cmin + (qmax / CAST(255 AS DOUBLE)) * (cmax - cmin) + 8 * CAST(2.220446049250313e-16 AS DOUBLE) * (abs(cmin) + abs(cmax)) END hi_b FROM q)"""


def _states_sql(name: str, lo: float, hi: float) -> str:
    return _blocks_sql(name) + f""",
s AS (SELECT chunk_id, unit_id, pos, n, CASE WHEN lo_b > {_number(lo)} AND hi_b <= {_number(hi)} THEN 1 WHEN hi_b <= {_number(lo)} OR lo_b > {_number(hi)} THEN 0 ELSE 2 END st FROM w)"""


_STATE_COUNTS = "(SELECT count(*) FROM s WHERE st = 1) AS in_blocks, (SELECT count(*) FROM s WHERE st = 0) AS out_blocks, (SELECT count(*) FROM s WHERE st = 2) AS maybe_blocks, (SELECT count(*) FROM s) AS total_blocks"


def _in(lo: float, hi: float) -> str:
    return f"v > {_number(lo)} AND v <= {_number(hi)}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# ---------------------------------------------------------------- COUNT

_INF = math.inf
for _name, _fixture, _args in (
    ("count_gt", "QTYS", (25, None, False, True)),
    ("count_ge", "QTYS", (25, None, True, True)),
    ("count_lt", "QTYS", (None, 10, False, False)),
    ("count_le", "QTYS", (None, 10, False, True)),
    ("count_range_oo", "DAY", (1500, 1700, False, False)),
    ("count_range_oc", "DAY", (1500, 1700, False, True)),
    ("count_range_co", "DAY", (1500, 1700, True, False)),
    ("count_range_cc", "DAY", (1500, 1700, True, True)),
    ("count_point_equal", "QTYS", (25, 25, True, True)),
    ("count_empty_range", "QTYS", (25, 25, False, True)),
    ("count_all_in", "QTY", (0, 60, False, True)),
    ("count_all_out", "QTY", (60, 70, False, True)),
):
    _lo, _hi = range_bounds(*_args)
    _add(
        _name,
        lambda s, d, f=_fixture, lo=_lo, hi=_hi: query.count(store(s, d, f), lo, hi).select("count", "in_blocks", "out_blocks", "maybe_blocks", "total_blocks"),
        f"WITH {_states_sql(_fixture, _lo, _hi)} SELECT (SELECT count(*) FROM c WHERE {_in(_lo, _hi)}) AS count, {_STATE_COUNTS}",
    )

for _name, _fixture, _lo, _hi in (("full_scan_count", "QTYS", 25.0, _INF), ("layer_full_equals_plain", "QTYS", 25.0, _INF)):
    _more = {"layers": (8, 24)} if _name == "layer_full_equals_plain" else {}
    _run = query.full_scan_count if not _more else lambda x, lo, hi: query.count(x, lo, hi).select("count")
    _add(_name, lambda s, d, f=_fixture, lo=_lo, hi=_hi, m=_more, r=_run: r(store(s, d, f, **m), lo, hi), f"WITH {_cells_sql(_fixture)} SELECT count(*) AS count FROM c WHERE {_in(_lo, _hi)}")

_ACCOUNT = ("useful_payload_bytes", "payload_bytes_read", "payload_overread_bytes", "metadata_bytes_read", "payload_requests", "metadata_requests", "bytes_read", "range_requests")


def _account(s: SparkSession, d: str, options: QueryOptions, **more) -> DataFrame:
    x = store(s, d, "DAY", **more)
    return query.count(x, 1500.0, 1700.0, options).select("count").crossJoin(query.accounting(x, 1500.0, 1700.0, options)).select("count", *_ACCOUNT)  # one row each


def _account_sql(record: int, reads: str) -> str:
    """reads: a query (n, size) of the payload's reads."""
    return f"""WITH {_states_sql('DAY', 1500.0, 1700.0)},
r AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chunk_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END brk FROM s WHERE st = 2),
g AS (SELECT *, sum(brk) OVER (PARTITION BY chunk_id ORDER BY pos) run FROM r),
m AS (SELECT chunk_id, max(pos) - min(pos) + 1 AS span FROM g GROUP BY chunk_id, run),
k AS ({reads}),
e AS (SELECT (SELECT count(*) FROM c WHERE {_in(1500.0, 1700.0)}) AS count, (SELECT count(*) * 192 FROM r) AS useful, (SELECT coalesce(sum(size), 0) FROM k) AS got, (SELECT count(DISTINCT unit_id) * {record} FROM s) AS meta, (SELECT coalesce(sum(n), 0) FROM k) AS n,
  (SELECT ceil((floor((max(t) + 16) / 16) * 2) / 16) FROM c) AS objects)
SELECT count, useful AS useful_payload_bytes, CAST(got AS BIGINT) AS payload_bytes_read, CAST(got - useful AS BIGINT) AS payload_overread_bytes, meta AS metadata_bytes_read, CAST(n AS BIGINT) AS payload_requests,
  CAST(objects AS BIGINT) AS metadata_requests, CAST(got + meta AS BIGINT) AS bytes_read, CAST(n + objects AS BIGINT) AS range_requests FROM e"""


_add("query_accounting", lambda s, d: _account(s, d, QueryOptions(merge_gap_blocks=2)), _account_sql(28, "SELECT count(*) n, sum(span) * 192 size FROM m"))
_add(
    "query_accounting_dense_chunks",
    lambda s, d: _account(s, d, QueryOptions(merge_gap_blocks=2, max_chunk_requests=2), layers=(8, 24)),
    _account_sql(32, "SELECT chunk_id, CASE WHEN count(*) * 2 > 2 THEN 1 ELSE count(*) * 2 END n, CASE WHEN count(*) * 2 > 2 THEN 64 ELSE sum(span) END * 192 size FROM m GROUP BY chunk_id"),
)

# ---------------------------------------------------------------- zone map and plans

_ZONES = ["chunk_id", "unit_id", "pos", "cmin", "cmax", "qmin", "qmax"]


def _plain(z: DataFrame) -> DataFrame:
    return z.select(*[F.col(c).cast("double" if c in ("cmin", "cmax") else "long").alias(c) for c in _ZONES])


def _zone_map(s: SparkSession, d: str, fixture: str, **more) -> DataFrame:
    return _plain(store(s, d, fixture, **more).zone_map)


def _repacked(s: SparkSession, d: str, packing: str | None) -> DataFrame:
    """The zone map after it was packed into objects and unpacked again, without the blocks that padding leaves out."""
    x = store(s, d, "QTYS")
    again = zarr.unpack(zarr.pack(x, packing), x.spec, packing)
    return _plain(again.join(x.zone_map.select("chunk_id", "pos"), ["chunk_id", "pos"], "left_semi"))


def _nibbles(s: SparkSession, d: str) -> DataFrame:
    """Lower halves of a unit's offsets as codes of 4 bits, packed; restored: unpacking gives them back."""
    of = store(s, d, "QTYS").zone_map.groupBy("unit_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("qmin") % 16).alias("c")))), lambda r: r["c"].cast("int")).alias("codes"))
    packed = of.withColumn("packed", pack_nibbles(F.col("codes")))
    whole = packed.withColumn("restored", unpack_nibbles(F.col("packed"), F.size("codes")) == F.col("codes"))
    return whole.select(F.col("unit_id").cast("long").alias("unit_id"), "restored", F.posexplode("packed").alias("place", "byte")).select("unit_id", F.col("place").cast("long").alias("place"), F.col("byte").cast("long").alias("byte"), "restored")


_ZONE_SQL = "SELECT chunk_id, unit_id, pos, cmin, cmax, CAST(qmin AS BIGINT) AS qmin, CAST(qmax AS BIGINT) AS qmax FROM q"
_add("zone_map_build", lambda s, d: _zone_map(s, d, "QTYS"), f"WITH {_blocks_sql('QTYS')} {_ZONE_SQL}")
_add(
    "zone_map_order_120",
    lambda s, d: _zone_map(s, d, "QTY", block_order=(1, 2, 0)),
    f"WITH {_blocks_sql('QTY', 'CAST(floor((y % 8) / 4) * 4 + floor((x % 8) / 4) * 2 + floor((t % 8) / 4) AS BIGINT)')} {_ZONE_SQL}",
)


for _name, _packing in (("pack_meta_roundtrip", "planar-zstd"), ("raw_meta_roundtrip", None)):
    _add(_name, lambda s, d, p=_packing: _repacked(s, d, p), f"WITH {_blocks_sql('QTYS')} {_ZONE_SQL}")
_add(
    "nibble_roundtrip",
    _nibbles,
    f"WITH {_blocks_sql('QTYS')}, r AS (SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY pos) - 1 k, CAST(qmin AS BIGINT) % 16 c FROM q) SELECT unit_id, k // 2 AS place, CAST(sum(c * CASE WHEN k % 2 = 0 THEN 1 ELSE 16 END) AS BIGINT) AS byte, TRUE AS restored FROM r GROUP BY unit_id, k // 2",
)


def _states(s: SparkSession, d: str, fixture: str, lo: float, hi: float) -> DataFrame:
    x = store(s, d, fixture)
    return planner.classified(x.zone_map, x.spec, lo, hi).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("pos").cast("long").alias("pos"), F.col("state").cast("long").alias("state"))


_add("plan_states", lambda s, d: _states(s, d, "QTYS", 10.0, 20.0), f"WITH {_states_sql('QTYS', 10.0, 20.0)} SELECT chunk_id, pos, CAST(st AS BIGINT) AS state FROM s")
_add("plan_maybe_list", lambda s, d: planner.to_count(_states(s, d, "QTYS", 10.0, 20.0)), f"WITH {_states_sql('QTYS', 10.0, 20.0)} SELECT chunk_id, pos, CAST(st AS BIGINT) AS state FROM s WHERE st = 2")
_add("plan_read_list", lambda s, d: planner.to_aggregate(_states(s, d, "QTYS", 10.0, 20.0)), f"WITH {_states_sql('QTYS', 10.0, 20.0)} SELECT chunk_id, pos, CAST(st AS BIGINT) AS state FROM s WHERE st <> 0")

_RUNS = """r AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chunk_id ORDER BY pos) <= {gap} + 1 THEN 0 ELSE 1 END brk FROM s WHERE st = 2),
g AS (SELECT *, sum(brk) OVER (PARTITION BY chunk_id ORDER BY pos) run FROM r)"""
for _name, _gap, _most in (("merge_runs_gap0", 0, None), ("merge_runs_gap2", 2, None), ("split_runs", 1, 8)):
    _part = f", floor((pos - min(pos) OVER (PARTITION BY chunk_id, run)) / {_most}) part" if _most else ", 0 part"
    _add(
        _name,
        lambda s, d, gap=_gap, most=_most: planner.merged(planner.to_count(_states(s, d, "QTY", 1.5, 49.0)), gap, most).select("chunk_id", "first", "last", "blocks"),
        f"WITH {_states_sql('QTY', 1.5, 49.0)}, {_RUNS.format(gap=_gap)}, p AS (SELECT *{_part} FROM g) SELECT chunk_id, min(pos) AS first, max(pos) AS last, count(*) AS blocks FROM p GROUP BY chunk_id, run, part",
    )


_GAPS = (0, 1, 2, 8)
_add(
    "gap_sweep",
    lambda s, d: sweep.gaps(store(s, d, "QTY"), 1.5, 49.0, _GAPS),
    f"WITH {_states_sql('QTY', 1.5, 49.0)}, " + ", ".join(f"r{g} AS (SELECT *, sum(brk) OVER (PARTITION BY chunk_id ORDER BY pos) run FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chunk_id ORDER BY pos) <= {g} + 1 THEN 0 ELSE 1 END brk FROM s WHERE st = 2)), m{g} AS (SELECT max(pos) - min(pos) + 1 span FROM r{g} GROUP BY chunk_id, run)" for g in _GAPS) + " " + " UNION ALL ".join(f"SELECT CAST({g} AS BIGINT) AS gap, count(*) AS payload_requests, CAST(sum(span) * 192 AS BIGINT) AS payload_bytes_read FROM m{g}" for g in _GAPS),
)


def _ranges(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars")
    from pyspark.sql import Window as W

    end = F.sum("n_chars").over(W.partitionBy("lang").orderBy("doc_id"))
    placed = docs.withColumn("end", end).withColumn("start", F.col("end") - F.col("n_chars")).where("doc_id % 3 <> 0")
    return planner.merged_ranges(placed, "lang", "start", "end", 1000).select("lang", "start", "end", "parts")


_add(
    "merge_runs_varsize",
    _ranges,
    """WITH p AS (SELECT doc_id, lang, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id) AS BIGINT) e, n_chars FROM documents),
k AS (SELECT lang, e - n_chars b, e FROM p WHERE doc_id % 3 <> 0),
r AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY lang ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 0 ELSE 1 END n FROM k),
g AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY b, e) run FROM r)
SELECT lang, min(b) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY lang, run""",
)

# ---------------------------------------------------------------- aggregates

for _name, _fixture, _lo, _hi in (("agg_gt", "QTYS", 25.0, _INF), ("agg_lt", "QTYS", -_INF, 9.5), ("agg_range", "DAY", 1500.0, 1700.0)):
    _add(
        _name,
        lambda s, d, f=_fixture, lo=_lo, hi=_hi: query.aggregate(store(s, d, f), lo, hi).select("count", "sum", "mean", "original_count_lo", "original_count_hi", "in_blocks", "out_blocks", "maybe_blocks", "total_blocks"),
        f"WITH {_states_sql(_fixture, _lo, _hi)}, a AS (SELECT count(*) n, sum(v) s FROM c WHERE {_in(_lo, _hi)}) SELECT n AS count, s AS sum, s / n AS mean, n AS original_count_lo, n AS original_count_hi, {_STATE_COUNTS} FROM a",
    )


def _read_blocks(s: SparkSession, d: str) -> DataFrame:
    _, blocks = query.aggregate(store(s, d, "QTYS"), 10.0, 20.0, return_blocks=True)
    return blocks.select(*[F.col(c).cast("long").alias(c) for c in blocks.columns])


_add("agg_read_blocks", _read_blocks, f"WITH {_states_sql('QTYS', 10.0, 20.0)} SELECT chunk_id, pos FROM s WHERE st <> 0")


def _truth(s: SparkSession, d: str, lo: float, hi: float, name: str = "PRICE") -> DataFrame:
    v = F.col("v").cast("double")
    hit = in_range(F.col("v"), lo, hi)
    return cells(s, d, name)[0].agg(F.count_if(hit).alias("true_count"), F.sum(F.when(hit, v)).alias("true_sum"))


def _contain(s: SparkSession, d: str, name: str, lo: float) -> DataFrame:
    """The true answers lie in the intervals, and these are not wider than the uncertain values allow."""
    row = query.aggregate(store(s, d, name, 8.0), lo, _INF).crossJoin(_truth(s, d, lo, _INF, name))
    n, t = F.col("true_count"), F.col("true_sum")
    return row.select(((F.col("original_count_hi") - F.col("original_count_lo")) < F.col("true_count") * 0.5).alias("narrow"), "true_count", n.between(F.col("original_count_lo"), F.col("original_count_hi")).alias("count_held"), t.between(F.col("original_sum_lo"), F.col("original_sum_hi")).alias("sum_held"), (t / n).between(F.col("original_mean_lo"), F.col("original_mean_hi")).alias("mean_held"))


_EMB_SQL = "c AS (SELECT CAST(CAST(unnest(embedding) AS FLOAT) AS DOUBLE) v FROM embeddings)"
_HELD = "SELECT TRUE AS narrow, count(*) AS true_count, TRUE AS count_held, TRUE AS sum_held, TRUE AS mean_held FROM c WHERE v >"
_add("agg_intervals_contain_truth", lambda s, d: _contain(s, d, "PRICE", 30000.0), f"WITH {_cells_sql('PRICE')} {_HELD} CAST(30000 AS DOUBLE)")
_add("agg_intervals_of_vectors", lambda s, d: _contain(s, d, "EMB", 0.05), f"WITH {_EMB_SQL} {_HELD} CAST(0.05 AS DOUBLE)")


def _layers(s: SparkSession, d: str) -> DataFrame:
    x, out = store(s, d, "PRICE", 8.0, layers=(2, 4, 8)), None
    truth = _truth(s, d, 30000.0, _INF).select("true_count")
    for layer in range(3):
        states = planner.classified(x.zone_map, x.spec, 30000.0, _INF, layer)
        bounds = states.agg(F.coalesce(F.sum(F.when(F.col("state") == 1, F.col("n"))), F.lit(0)).alias("low"), F.coalesce(F.sum(F.when(F.col("state") > 0, F.col("n"))), F.lit(0)).alias("high"))
        got = query.count(x, 30000.0, _INF, QueryOptions(layer=layer)).select("count")
        row = got.crossJoin(bounds).crossJoin(truth).select(F.lit(layer).cast("long").alias("layer"), "true_count", F.col("count").between(F.col("low"), F.col("high")).alias("count_held"), F.col("true_count").between(F.col("low"), F.col("high")).alias("truth_held"))
        out = row if out is None else out.union(row)
    return out


_add("layer_count_prefix", _layers, f"WITH {_cells_sql('PRICE')} SELECT CAST(l AS BIGINT) AS layer, (SELECT count(*) FROM c WHERE v > CAST(30000 AS DOUBLE)) AS true_count, TRUE AS count_held, TRUE AS truth_held FROM range(0, 3) r(l)")


def _errors(s: SparkSession, d: str) -> DataFrame:
    """Each block's true error against its unit's eps and its own 4-bit bound."""
    x = store(s, d, "PRICE", 8.0, block_error_bits=4)
    got = st.decoded(x.payload, x.spec).withColumnRenamed("v", "r")
    both = st.blocks_of(cells(s, d, "PRICE")[0], x.spec).join(got, ["chunk_id", "pos"]).join(x.zone_map.select("chunk_id", "pos", "eps0", "code"), ["chunk_id", "pos"])
    err = F.array_max(F.zip_with("v", "r", lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    return both.select(err.alias("err"), "eps0", "code", (F.col("eps0") * F.col("code") / 15.0).alias("bound"))


_N_BLOCKS = f"WITH {_blocks_sql('PRICE')} SELECT count(*) AS blocks"
_add("max_error_le_eps", lambda s, d: query.max_error(store(s, d, "PRICE", 8.0), cells(s, d, "PRICE")[0]).select("blocks", "held"), f"{_N_BLOCKS}, TRUE AS held FROM b")
# A code is the least of 16 steps that holds: one step less would not, unless the error is 0.
_add(
    "block_error_codes",
    lambda s, d: _errors(s, d).agg(F.count("*").alias("blocks"), F.bool_and((F.col("err") <= F.col("bound")) & F.col("code").between(0, 15)).alias("held"), F.bool_and((F.col("code") == 0) | (F.col("eps0") * (F.col("code") - 1) / 15.0 < F.col("err"))).alias("least")),
    f"{_N_BLOCKS}, TRUE AS held, TRUE AS least FROM b",
)


def _tighten(s: SparkSession, d: str) -> DataFrame:
    with_codes, plain = (query.aggregate(store(s, d, "PRICE", 8.0, **m), 30000.0, _INF) for m in ({"block_error_bits": 4}, {}))
    a = with_codes.select("count", (F.col("original_count_hi") - F.col("original_count_lo")).alias("narrow"))
    b = plain.select((F.col("original_count_hi") - F.col("original_count_lo")).alias("wide"), F.col("count").alias("plain"))
    return a.crossJoin(b).select((F.col("narrow") < F.col("wide")).alias("narrower"), (F.col("count") == F.col("plain")).alias("same_count"))


_add("codes_tighten", _tighten, "SELECT TRUE AS narrower, TRUE AS same_count")

# ---------------------------------------------------------------- intervals, regions, points

_add("meta_count_interval", lambda s, d: query.count_interval(store(s, d, "QTYS"), 10.0, 20.0), f"WITH {_states_sql('QTYS', 10.0, 20.0)} SELECT CAST((SELECT coalesce(sum(n), 0) FROM s WHERE st = 1) AS BIGINT) AS count_lo, CAST((SELECT coalesce(sum(n), 0) FROM s WHERE st <> 0) AS BIGINT) AS count_hi")


def _zone_sql(fixture: str, shape: tuple[int, int, int]) -> str:
    return _cells_sql(fixture) + f", z AS (SELECT floor(t / {shape[0]}) a, floor(y / {shape[1]}) e, floor(x / {shape[2]}) f, min(v) low, max(v) high, count(*) n FROM c GROUP BY ALL)"


_add(
    "zone_shape_intervals",
    lambda s, d: explore.zone_interval(cells(s, d, "QTYS")[0], (4, 8, 16), 10.0, 20.0),
    f"WITH {_zone_sql('QTYS', (4, 8, 16))} SELECT CAST(coalesce(sum(n) FILTER (low > 10 AND high <= 20), 0) AS BIGINT) AS count_lo, CAST(coalesce(sum(n) FILTER (NOT (high <= 10 OR low > 20)), 0) AS BIGINT) AS count_hi FROM z",
)
for _name, _shape, _shard in (("chunk_zone_map_count", (16, 16, 16), None), ("inner_zone_map_count", (4, 4, 16), (16, 16, 16))):
    _add(
        _name,
        lambda s, d, shape=_shape, shard=_shard: baseline.zone_count(chunked(s, d, "DAY", shape, shard), 1500.0, 1700.0),
        f"WITH {_zone_sql('DAY', _shape)} SELECT (SELECT count(*) FROM c WHERE v > 1500 AND v <= 1700) AS count, count(*) FILTER (NOT (low > 1500 AND high <= 1700) AND NOT (high <= 1500 OR low > 1700)) AS zones_read, count(*) AS zones FROM z",
    )
_add("full_scan_compressed", lambda s, d: baseline.full_scan_count(chunked(s, d, "PRICE", (16, 16, 16)), 30000.0, _INF), f"WITH {_cells_sql('PRICE')} SELECT count(*) AS count FROM c WHERE {_in(30000.0, _INF)}")
_add(
    "shard_index",
    lambda s, d: baseline.shard_index(chunked(s, d, "DAY", (4, 4, 16), (16, 16, 16))).groupBy(F.col("name").cast("long").alias("shard")).agg(F.count("*").alias("inner_chunks"), (F.sum("size") == F.max(F.col("offset") + F.col("size"))).alias("gapless")),
    f"WITH {_cells_sql('DAY')}, k AS (SELECT DISTINCT floor(t / 4) a, floor(y / 4) e FROM c) SELECT CAST(floor(a / 4) AS BIGINT) AS shard, count(*) AS inner_chunks, TRUE AS gapless FROM k GROUP BY 1",
)


def _tolerant(s: SparkSession, d: str) -> DataFrame:
    """Fixed-accuracy chunks: the zones' intervals, widened by the largest error, hold the count of stored values."""
    x = chunked(s, d, "PRICE", (16, 16, 16), tolerance=64.0)
    a, b = baseline.zone_count(x, 30000.0, _INF).select("count"), baseline.full_scan_count(x, 30000.0, _INF).select(F.col("count").alias("whole"))
    worst = x.stats.agg((F.max("err") <= 64).alias("held"))
    return a.crossJoin(b).crossJoin(worst).select((F.col("count") == F.col("whole")).alias("same"), "held")


_add("fixed_accuracy_counts", _tolerant, "SELECT TRUE AS same, TRUE AS held")
_add("tolerance_search", lambda s, d: explore.tolerance_search(store(s, d, "PRICE", 8.0), cells(s, d, "PRICE")[0], 4096.0).where("ok").select("ok"), "SELECT TRUE AS ok")


def _wide(cells_: DataFrame) -> DataFrame:
    """Decoded days with an error that grows with the value."""
    return explore.mean_interval(cells_, F.col("v") * 0.01, 2000.0).select("n", "may", F.round("mean_lo", 6).alias("mean_lo"), F.round("mean_hi", 6).alias("mean_hi"))


_add(
    "avg_interval_sorted_prefix",
    lambda s, d: _wide(explore.cells_with_errors(store(s, d, "DAY"))),
    f"""WITH {_cells_sql('DAY')}, e AS (SELECT v, v * CAST(0.01 AS DOUBLE) e FROM c), a AS (SELECT count(*) n, coalesce(sum(v + e), 0) up, coalesce(sum(v - e), 0) down FROM e WHERE v > 2000 + e),
m AS (SELECT row_number() OVER (ORDER BY v + e DESC) k, sum(v + e) OVER (ORDER BY v + e DESC ROWS UNBOUNDED PRECEDING) s FROM e WHERE v > 2000 - e AND NOT v > 2000 + e)
SELECT n, (SELECT count(*) FROM m) AS may, round((down + (SELECT count(*) FROM m) * 2000) / (n + (SELECT count(*) FROM m)), 6) AS mean_lo, round(greatest(up / n, (SELECT max((up + s) / (n + k)) FROM m)), 6) AS mean_hi FROM a""",
)


def _filtered(s: SparkSession, d: str) -> DataFrame:
    """COUNT and AVG of originals lie in the intervals by units' and by blocks' errors; the second is narrower."""
    x = store(s, d, "PRICE", 8.0, block_error_bits=4)
    t = _truth(s, d, 30000.0, _INF)
    out = None
    for name, blocks in (("unit", False), ("block", True)):
        row = explore.filtered_mean(x, 30000.0, blocks).crossJoin(t)  # one row each
        row = row.select(
            F.col("true_count").between(F.col("n"), F.col("n") + F.col("may")).alias(f"{name}_count_held"),
            (F.col("true_sum") / F.col("true_count")).between(F.col("mean_lo"), F.col("mean_hi")).alias(f"{name}_mean_held"),
            (F.col("mean_hi") - F.col("mean_lo")).alias(f"{name}_width"),
        )
        out = row if out is None else out.crossJoin(row)
    return out.select("unit_count_held", "unit_mean_held", "block_count_held", "block_mean_held", (F.col("block_width") < F.col("unit_width")).alias("narrower"))


_add("filtered_mean_contains_truth", _filtered, "SELECT TRUE AS unit_count_held, TRUE AS unit_mean_held, TRUE AS block_count_held, TRUE AS block_mean_held, TRUE AS narrower")
_BOX = "y >= 2 AND y < 13 AND x >= 5 AND x < 16"
for _name, _order in (("region_avg_min_max", (0, 1, 2)), ("region_block_order", (1, 2, 0))):
    _add(
        _name,
        lambda s, d, o=_order: query.region(store(s, d, "DAY", **({"block_order": o} if o != (0, 1, 2) else {})), (2, 13), (5, 16)).select("n", F.round("avg", 6).alias("avg"), "min", "max", "eps", "blocks"),
        f"WITH {_cells_sql('DAY')} SELECT count(*) AS n, round(avg(v), 6) AS avg, min(v) AS min, max(v) AS max, CAST(0 AS DOUBLE) AS eps, (SELECT count(DISTINCT (floor(t / 4), floor(y / 4), floor(x / 4))) FROM c WHERE {_BOX}) AS blocks FROM c WHERE {_BOX}",
    )


def _bounds(s: SparkSession, d: str) -> DataFrame:
    """At each rate, and with codes of blocks: what a box's decoded AVG, MIN and MAX are off by is within all three bounds, and the means of errors are in order."""
    v = F.col("v").cast("double")
    true = cells(s, d, "PRICE")[0].where(_BOX).agg(F.avg(v).alias("t_avg"), F.min(v).alias("t_min"), F.max(v).alias("t_max"), F.count("*").alias("t_n"))
    out = None
    for name, x, layer in [(f"layer {k}", store(s, d, "PRICE", 8.0, layers=(2, 4, 8)), k) for k in range(3)] + [("codes", store(s, d, "PRICE", 8.0, block_error_bits=4), 0)]:
        row = query.region(x, (2, 13), (5, 16), layer).crossJoin(true)  # one row each
        held = F.lit(True)
        for m in ("avg", "min", "max"):
            for b in "abc":
                held = held & (F.abs(F.col(m) - F.col(f"t_{m}")) <= F.col(f"{m}_bound_{b}") + 1e-9)
        row = row.select(F.lit(name).alias("kind"), F.col("t_n").alias("n"), (F.col("n") == F.col("t_n")).alias("same_n"), held.alias("held"), (F.col("avg_bound_c") <= F.col("avg_bound_b") + 1e-9).alias("b_c"), (F.col("avg_bound_b") < F.col("avg_bound_a")).alias("a_b"))
        out = row if out is None else out.union(row)
    return out


_add("region_bounds_hold", _bounds, f"WITH {_cells_sql('PRICE')} SELECT kind, (SELECT count(*) FROM c WHERE {_BOX}) AS n, TRUE AS same_n, TRUE AS held, TRUE AS b_c, TRUE AS a_b FROM (VALUES ('layer 0'), ('layer 1'), ('layer 2'), ('codes')) k(kind)")
_add(
    "region_meta_minmax",
    lambda s, d: query.region_meta_minmax(store(s, d, "DAY"), (2, 13), (5, 16)),
    f"""WITH {_blocks_sql('DAY')}, t AS (SELECT *, fy * 4 >= 2 AND fy * 4 + 4 <= 13 AND fx * 4 >= 5 AND fx * 4 + 4 <= 16 inside FROM w WHERE fy BETWEEN 0 AND 3 AND fx BETWEEN 1 AND 3)
SELECT min(lo_b) AS min_lo, min(hi_b) FILTER (inside) AS min_hi, max(lo_b) FILTER (inside) AS max_lo, max(hi_b) AS max_hi FROM t""",
)


_add("region_read_cost", lambda s, d: query.region_read_cost(store(s, d, "DAY"), (2, 13), (5, 16)), f"WITH {_blocks_sql('DAY')} SELECT count(*) * 192 + count(DISTINCT unit_id) * 28 AS bytes FROM w WHERE fy <= 3 AND fx BETWEEN 1 AND 3")
_POINTS = ((0, 0), (3, 7), (3, 6), (15, 15))


def _series(found: DataFrame) -> DataFrame:
    return found.select(*[F.col(c).cast("long").alias(c) for c in "tyx"], F.col("v").cast("double").alias("v"))


def _points(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(_POINTS), "y int, x int")


def _near(s: SparkSession, y: int, x: int, n: int) -> DataFrame:
    """The n points of the grid nearest to one, the first in C order of equally near ones."""
    grid = s.range(256).select(F.floor(F.col("id") / 16).cast("int").alias("y"), (F.col("id") % 16).cast("int").alias("x"), "id")
    return grid.orderBy((F.col("y") - y) ** 2 + (F.col("x") - x) ** 2, "id").limit(n)


_POINT_SQL = f"WITH {_cells_sql('QTY')} SELECT t, y, x, v FROM c WHERE (y, x) IN {_POINTS}"
_add("point_series", lambda s, d: _series(query.point_series(store(s, d, "QTY"), _points(s))), _POINT_SQL)
_add("point_series_block_order", lambda s, d: _series(query.point_series(store(s, d, "QTY", block_order=(1, 2, 0)), _points(s))), _POINT_SQL)
_add("point_series_chunks", lambda s, d: _series(baseline.point_series(chunked(s, d, "QTY", (16, 8, 8)), _points(s))), _POINT_SQL)
_add("point_series_shards", lambda s, d: _series(baseline.point_series(chunked(s, d, "QTY", (4, 4, 8), (16, 16, 16)), _points(s))), _POINT_SQL)
_add(
    "point_series_cluster",
    lambda s, d: _series(query.point_series(store(s, d, "QTY"), _near(s, 5, 9, 6))),
    f"WITH {_cells_sql('QTY')}, p AS (SELECT i // 16 py, i % 16 px FROM range(0, 256) r(i) ORDER BY (i // 16 - 5) ** 2 + (i % 16 - 9) ** 2, i LIMIT 6) SELECT t, y, x, v FROM c JOIN p ON y = py AND x = px",
)


def _sample(s: SparkSession, d: str, budget: int, **box) -> DataFrame:
    rows = cells(s, d, "PRICE")[0]
    return explore.sampled_mean(rows, explore.chunk_bytes(rows, (16, 16, 16)), budget, **box)


_add("sample_avg_clt", lambda s, d: _sample(s, d, 40_000, y=(2, 13), x=(5, 16)))
_add("sample_avg_all", lambda s, d: _sample(s, d, 1 << 60).select(F.round("mean", 4).alias("mean"), F.round("half_width", 9).alias("half_width")), f"WITH {_cells_sql('PRICE')} SELECT round(avg(v), 4) AS mean, CAST(0 AS DOUBLE) AS half_width FROM c")


def _zarr(s: SparkSession, d: str, packing: str | None) -> DataFrame:
    """COUNT over the whole chunks of a fixture that were written as a Zarr directory and read back."""
    found, steps, n = cells(s, d, "DAY")
    whole = n // 4096 * 16
    x = st.create(found.where(F.col("t") < whole), ArraySpec((whole, 16, 16), (16, 16, 16), (8, 8, 8), (1, 2, 0), rate=24))
    folder = f"{st.shared_folder(s)}/zarr-{uuid.uuid4().hex}"
    zarr.save(zarr.objects(x, packing=packing), folder)
    return query.count(zarr.read(s, folder), 1500.0, 1700.0).select("count", "total_blocks")


for _name, _packing in (("zarr_count", None), ("zarr_packed_count", "planar-zstd")):
    _add(_name, lambda s, d, p=_packing: _zarr(s, d, p), f"WITH {_cells_sql('DAY')} SELECT count(*) FILTER ({_in(1500.0, 1700.0)}) AS count, CAST(count(*) // 64 AS BIGINT) AS total_blocks FROM c WHERE t < (SELECT count(*) // 4096 * 16 FROM c)")

_SELECTED = (0.01, 0.1, 0.5)
_add(
    "selectivity_sweep",
    lambda s, d: sweep.selectivities(store(s, d, "DAY"), cells(s, d, "DAY")[0], _SELECTED).select("selectivity", F.round("threshold", 6).alias("threshold"), "count", "truth", "count_error"),
    f"WITH {_cells_sql('DAY')}, k AS (" + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS selectivity, quantile_cont(v, {1 - x}) AS threshold FROM c" for x in _SELECTED) + ") SELECT selectivity, round(threshold, 6) AS threshold, (SELECT count(*) FROM c WHERE v > k.threshold) AS count, (SELECT count(*) FROM c WHERE v > k.threshold) AS truth, CAST(0 AS DOUBLE) AS count_error FROM k",
)
_add(
    "ablation_counts",
    lambda s, d: sweep.ablation(store(s, d, "DAY"), cells(s, d, "DAY")[0], 1500.0).select("config", "count"),
    f"WITH {_cells_sql('DAY')} SELECT config, (SELECT count(*) FROM c WHERE v > 1500) AS count FROM (VALUES ('default'), ('gap_0'), ('gap_64k'), ('order_time'), ('layers'), ('codes'), ('no_pruning')) k(config)",
)

# ---------------------------------------------------------------- statistics

_QS = [0.0, 0.1, 0.333, 0.5, 0.9, 0.99, 1.0]
_add(
    "exact_quantiles",
    lambda s, d: explore.quantiles(s.read.parquet(f"{d}/events.parquet"), F.col("value"), _QS).select("q", F.round("value", 9).alias("value")),
    " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, round(quantile_cont(CAST(value AS DOUBLE), {q}), 9) AS value FROM events" for q in _QS),
)


_add(
    "threshold_truth",
    lambda s, d: explore.thresholds(cells(s, d, "PRICE")[0], (0.01, 0.1, 0.5)).select("selectivity", F.round("threshold", 6).alias("threshold"), "true_count"),
    f"WITH {_cells_sql('PRICE')}, k AS (" + " UNION ALL ".join(f"SELECT CAST({x} AS DOUBLE) AS selectivity, quantile_cont(v, {1 - x}) AS threshold FROM c" for x in (0.01, 0.1, 0.5)) + ") SELECT selectivity, round(threshold, 6) AS threshold, (SELECT count(*) FROM c WHERE v > k.threshold) AS true_count FROM k",
)
_add(
    "sortable_keys",
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(F.explode("embedding").alias("v")).select(sort_key(F.col("v")).alias("k")).agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).select("n", key_value(F.col("a")).alias("least"), key_value(F.col("b")).alias("most")),
    f"WITH {_EMB_SQL} SELECT count(*) AS n, min(v) AS least, max(v) AS most FROM c",
)
_add(
    "wilson_interval",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 49).alias("k"), F.count("*").alias("n")).select("l_returnflag", *[F.round(c, 9).alias(n) for c, n in zip(explore.wilson(F.col("k"), F.col("n")), ("low", "high"), strict=True)]),
    """WITH a AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 49) k, count(*) n FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag, k / n p, n, CAST(1.96 AS DOUBLE) z FROM a)
SELECT l_returnflag, round(greatest((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0), 9) AS low, round(least((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 1), 9) AS high FROM b""",
)
_add("overhead_formula", lambda s, d: s.range(1, 65).select(F.col("id").alias("n"), F.round(explore.overhead(F.col("id"), F.lit(8.0)), 12).alias("overhead")), "SELECT n, round((12 + 2 * n) / (n * 64 * CAST(8 AS DOUBLE) / 8), 12) AS overhead FROM range(1, 65) r(n)")
_add(
    "wind_speed_derived",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(explore.wind_speed(F.col("l_discount"), F.col("l_tax")).alias("ws")).agg(F.count("*").alias("n"), F.min("ws").cast("double").alias("least"), F.max("ws").cast("double").alias("most")),
    "SELECT count(*) AS n, CAST(min(ws) AS DOUBLE) AS least, CAST(max(ws) AS DOUBLE) AS most FROM (SELECT CAST(sqrt(CAST(l_discount AS DOUBLE) ** 2 + CAST(l_tax AS DOUBLE) ** 2) AS FLOAT) ws FROM lineitem)",
)
_add(
    "abs_gt_count",
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(F.size(F.filter("embedding", lambda x: F.abs(x.cast("double")) > 0.2)).alias("n")).agg(F.sum("n").alias("count")),
    "SELECT CAST(sum(len(list_filter(embedding, lambda x: abs(CAST(x AS DOUBLE)) > CAST(0.2 AS DOUBLE)))) AS BIGINT) AS count FROM embeddings",
)


def _stale(s: SparkSession, d: str) -> DataFrame:
    """A chunk whose last value was written over is found by its checksum."""
    found, steps, n = cells(s, d, "QTY")
    spec = ArraySpec((steps, 16, 16), (16, 16, 16), (8, 8, 8), rate=24, length=n)
    x = st.create(found, spec)
    last = (F.col("t") * 256 + F.col("y") * 16 + F.col("x")) == n - 1
    st.write_payload(found.withColumn("v", F.when(last, F.lit(1000.0)).otherwise(F.col("v")).cast("float")), spec, x.folder)
    return st.check_meta(x).select(F.col("chunk_id").cast("long").alias("chunk_id"))


_add("stale_chunks", _stale, "SELECT CAST((count(*) - 1) // 4096 AS BIGINT) AS chunk_id FROM lineitem")


def _runs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select("event_type", F.col("value").cast("double").alias("value"))


_TYPES = "t AS (SELECT min(event_type) a, max(event_type) b FROM events)"


def _faster(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d)
    a, b = r.agg(F.min("event_type"), F.max("event_type")).first()
    return explore.p_faster(r, "event_type", "value", a, b).select(F.round("p_faster", 9).alias("p_faster"))


_add("p_faster", _faster, f"WITH {_TYPES}, x AS (SELECT CAST(value AS DOUBLE) v FROM events, t WHERE event_type = a), y AS (SELECT CAST(value AS DOUBLE) w FROM events, t WHERE event_type = b) SELECT round(avg(CASE WHEN v < w THEN CAST(1 AS DOUBLE) WHEN v = w THEN 0.5 ELSE 0 END), 9) AS p_faster FROM x, y")
_SPREAD_SQL = "SELECT event_type, count(*) AS n, round(quantile_cont(CAST(value AS DOUBLE), 0.25), 9) AS p25, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 9) AS median, round(quantile_cont(CAST(value AS DOUBLE), 0.75), 9) AS p75, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 9) AS p95, CAST(max(value) AS DOUBLE) AS most FROM events GROUP BY event_type"
_add("run_spread", lambda s, d: explore.spread(_runs(s, d), ["event_type"], "value").select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("p25", "median", "p75", "p95")], "most"), _SPREAD_SQL)
_add("best_baseline", lambda s, d: explore.spread(_runs(s, d), ["event_type"], "value").agg(F.min_by("event_type", F.struct("median", "event_type")).alias("best")), f"WITH s AS ({_SPREAD_SQL}) SELECT event_type AS best FROM s ORDER BY median, event_type LIMIT 1")


_MEASURES = ("l_quantity", "l_extendedprice")
_add(
    "report_groupby",
    lambda s, d: explore.report(s.read.parquet(f"{d}/lineitem.parquet"), ["l_returnflag"], list(_MEASURES)).select("l_returnflag", "measure", "n", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75", "p95", "most")]),
    " UNION ALL ".join(f"SELECT l_returnflag, '{m}' AS measure, count(*) AS n, " + ", ".join(f"round(quantile_cont(CAST({m} AS DOUBLE), {q}), 6) AS {n}" for q, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"), (1, "most"))) + " FROM lineitem GROUP BY l_returnflag" for m in _MEASURES),
)
_add(
    "count_errors",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("a"), F.count_if(F.col("l_quantity") > 41).alias("b"), F.count_if(F.col("l_quantity") > 99).alias("none")).select("l_returnflag", F.round(explore.count_error(F.col("a"), F.col("b")), 12).alias("error"), explore.count_error(F.col("a"), F.col("none")).alias("of_none"), F.round(explore.read_fraction(F.col("b"), F.col("a")), 12).alias("fraction")),
    "WITH a AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 40) a, count(*) FILTER (l_quantity > 41) b FROM lineitem GROUP BY 1) SELECT l_returnflag, round(abs(a - b) / CAST(b AS DOUBLE), 12) AS error, CAST(0 AS DOUBLE) AS of_none, round(b / CAST(a AS DOUBLE), 12) AS fraction FROM a",
)
_add(
    "queries_to_repay",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber").agg(*[F.avg(F.col(c).cast("double")).alias(k) for k, c in (("build", "l_extendedprice"), ("scan", "l_quantity"))], F.lit(25.5).alias("q")).select("l_linenumber", F.round(explore.repay(F.col("build"), F.col("scan"), F.col("q")), 3).alias("queries")),
    "WITH a AS (SELECT l_linenumber, avg(CAST(l_extendedprice AS DOUBLE)) build, avg(CAST(l_quantity AS DOUBLE)) scan FROM lineitem GROUP BY 1) SELECT l_linenumber, CASE WHEN scan > 25.5 THEN round(build / (scan - CAST(25.5 AS DOUBLE)), 3) END AS queries FROM a",
)


def _bootstrap(s: SparkSession, d: str) -> DataFrame:
    """A ratio of medians with its interval, the median of all and whether the interval holds the ratio."""
    r = _runs(s, d)
    a, b = r.agg(F.min("event_type"), F.max("event_type")).first()
    return explore.bootstrap_ratio(r, "event_type", "value", a, b).select(F.round("ratio", 9).alias("ratio"), F.col("ratio").between(F.col("low"), F.col("high")).alias("held"))


_add("bootstrap_ratio_ci", _bootstrap, f"WITH {_TYPES} SELECT round((SELECT quantile_cont(CAST(value AS DOUBLE), 0.5) FROM events, t WHERE event_type = a) / (SELECT quantile_cont(CAST(value AS DOUBLE), 0.5) FROM events, t WHERE event_type = b), 9) AS ratio, TRUE AS held")


def _best(s: SparkSession, d: str) -> DataFrame:
    r = _runs(s, d)
    names = sorted(x[0] for x in r.select("event_type").distinct().collect())
    return explore.best_ratio(r, "event_type", "value", names[:-1], names[-1]).select(F.round("ratio", 9).alias("ratio"), F.col("ratio").between(F.col("low"), F.col("high")).alias("held"))


_add("best_ratio_ci", _best, "WITH m AS (SELECT event_type, quantile_cont(CAST(value AS DOUBLE), 0.5) q FROM events GROUP BY 1), l AS (SELECT max(event_type) o FROM m) SELECT round((SELECT min(q) FROM m, l WHERE event_type <> o) / (SELECT q FROM m, l WHERE event_type = o), 9) AS ratio, TRUE AS held")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
