"""One JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; pruned against full scans on the same engine."""

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + ":" + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gridstone import queries as q  # noqa: E402
from gridstone.operators import explore, query  # noqa: E402
from gridstone.plans.spec import ArraySpec  # noqa: E402
from gridstone.runlog import RunLog  # noqa: E402
from gridstone.sources.counting import measured  # noqa: E402
from gridstone.sources.store import Store, create  # noqa: E402

TILES = 32


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run, warm: bool = True) -> None:
        if warm:
            run()
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    timed("build_cells", lambda: q.cells(spark, sf, "PRICES"), warm=False)
    one, _, n = q.cells(spark, sf, "PRICES")
    # The same rows several times one after another: at this size a job's fixed cost would hide what is read.
    i = F.col("t").cast("long") * 256 + F.col("y") * 16 + F.col("x") + F.col("k") * n
    rows = one.crossJoin(spark.range(TILES).withColumnRenamed("id", "k")).select(F.floor(i / 256).cast("int").alias("t"), F.floor(i % 256 / 16).cast("int").alias("y"), (i % 16).cast("int").alias("x"), "v")
    spec = ArraySpec((-(-n * TILES // 4096) * 16, 16, 16), (16, 16, 16), (8, 8, 8), rate=12, length=n * TILES)
    made: list[Store] = []
    timed("build_store", lambda: made.append(create(rows, spec)), warm=False)
    s = made[0]
    cuts = [r.value for r in explore.quantiles(one, F.col("v"), [0.99, 0.9, 0.5]).collect()]
    read: dict[str, int] = {}
    for share, cut in zip((0.01, 0.1, 0.5), cuts, strict=True):
        timed(f"count_{share:g}", lambda cut=cut: query.count(s, cut, math.inf).collect())
        timed(f"sum_{share:g}", lambda cut=cut: query.aggregate(s, cut, math.inf).collect())
        read[f"count_{share:g}"] = measured(spark, lambda cut=cut: query.count(s, cut, math.inf).collect())[1].bytes_read
    timed("count_full_scan", lambda: query.full_scan_count(s, cuts[0], math.inf).collect())
    read["count_full_scan"] = measured(spark, lambda: query.full_scan_count(s, cuts[0], math.inf).collect())[1].bytes_read
    timed("count_interval", lambda: query.count_interval(s, cuts[1], cuts[0]).collect())
    timed("region", lambda: q.QUERIES["region_avg_min_max"](spark, sf).collect())
    timed("point_series", lambda: q.QUERIES["point_series"](spark, sf).collect())
    timed("exact_quantiles", lambda: q.QUERIES["exact_quantiles"](spark, sf).collect())
    if os.environ.get("BENCH_LOG"):
        log = RunLog(os.environ["BENCH_LOG"], sf, cpus=cpus)
        for name, seconds in took.items():
            log.add(query=name, seconds=seconds, bytes_read=read.get(name))
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "bytes_read": read, "sf": sf}))


if __name__ == "__main__":
    main()
