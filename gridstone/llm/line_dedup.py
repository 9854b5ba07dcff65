"""Line dedup: lines that many sites share are boilerplate. Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.common import aside, digest, mark_for, named, restored, settled

#: A line on so many different sites is boilerplate.
LEAST_SITES = 8
#: log2 of a sketch's size, and three of its standard errors.
LG_K, MARGIN = 10, 0.1
#: Lines that are broadcast at most, so that a frequent line's rows aren't shuffled to one task; more are joined by shuffles.
MOST_LISTED = 500_000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", id_column: str = "doc_id", least_sites: int = LEAST_SITES) -> DataFrame:
    """(h, owner): hashes of the lines on at least least_sites different sites, and the smallest id that has the line.

    Every line with a character other than ASCII white space is judged, however short. A
    sketch per line hash estimates its sites; estimates within MARGIN of the threshold are
    replaced by exact distinct counts. A null site is a site of its own.
    """
    place = F.coalesce(F.concat(F.lit("="), named(site).cast("string")), F.lit(""))
    filled = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(named(text)), filled), _line_hash))
    rows = docs.select(named(id_column).alias("id"), place.alias("site"), F.explode(hashes).alias("h"))
    # A site's rows of a line first become one, then sketches merge: both by partial aggregation.
    sketched = rows.groupBy("h").agg(F.min("id").alias("owner"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = sketched.select("h", "owner", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least_sites * (1 - MARGIN) - 1)
    spread, n = settled(spread)
    sure = spread.where(F.col("sites") > least_sites * (1 + MARGIN) + 1).select("h", "owner")
    near = spread.where(F.col("sites") <= least_sites * (1 + MARGIN) + 1)
    asked = near.select("h")
    exact = rows.join(F.broadcast(asked) if n <= MOST_LISTED else asked, "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least_sites)
    return sure.union(near.join(exact.select("h"), "h", "left_semi").select("h", "owner"))


def clean(docs: DataFrame, text: str = "text", site: str = "source", id_column: str = "doc_id", least_sites: int = LEAST_SITES) -> DataFrame:
    """docs without boilerplate lines, with n_lines (before) and n_removed.

    The document of the smallest id keeps its copy of a line, so that nothing vanishes from
    the corpus; every other document loses all copies. Lines are parts between \\n; lines of
    ASCII white space alone stay. Null text: stays null, with 0 lines. Null id: such rows own
    a line only if all its rows have null ids. Repeated rows are treated alike. Empty table:
    no rows. Columns n_lines and n_removed of docs are replaced, any other kept, whatever
    its name.
    """
    bad, n_bad = settled(boilerplate(docs, text, site, id_column, least_sites))
    bad = F.broadcast(bad) if n_bad <= MOST_LISTED else bad
    mark = mark_for(docs)
    node, found_bad, mine, left = (f"{mark}{x}" for x in ("node", "bad", "mine", "left"))
    kept_names = docs.drop("n_lines", "n_removed").columns
    hashes = F.array_distinct(F.transform(_lines(named(text)), _line_hash))
    found = docs.select(digest(named(text)).alias(node), F.explode(hashes).alias("h")).join(bad, "h").distinct()
    listed = found.groupBy(node).agg(F.collect_list(F.struct("h", "owner")).alias(found_bad))
    d = docs.drop("n_lines", "n_removed").withColumn(node, digest(named(text))).join(listed, node, "left")
    none = F.array().cast(listed.schema[found_bad].dataType)
    others = F.filter(F.coalesce(found_bad, none), lambda b: ~b["owner"].eqNullSafe(named(id_column)))
    d = d.withColumn(mine, F.transform(others, lambda b: b["h"]))
    d = d.withColumn(left, F.when(F.size(mine) > 0, F.filter(_lines(named(text)), lambda line: ~F.array_contains(F.col(mine), _line_hash(line)))))
    n_lines = F.when(named(text).isNull(), 0).otherwise(F.size(_lines(named(text)))).cast("long")
    n_removed = F.when(F.col(left).isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size(left)).cast("long")
    whole = F.when(F.col(left).isNull(), named(text)).otherwise(F.array_join(left, "\n")).alias(text)
    return d.select(*[whole if c == text else named(c) for c in kept_names], n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def without_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", id_column: str = "doc_id", least_sites: int = LEAST_SITES) -> DataFrame:
    """docs with their own columns, whatever the names, and the texts of clean()."""
    rows, back = aside(docs, ["n_lines", "n_removed"])
    return restored(clean(rows, text, site, id_column, least_sites), docs.columns, back)
