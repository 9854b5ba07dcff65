"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstone.llm.common import mark_for, named

#: The filter never outgrows this; a longer list means more false hits, which the exact join removes.
MOST_BYTES = 32 << 20
_LANES = 8  # a block is 8 words of 64 bits; an entry sets one bit in each


def _whole(url: str | Column) -> Column:
    return F.coalesce(named(url) if isinstance(url, str) else url, F.lit(""))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return _lower(F.regexp_extract(_whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: str | Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.regexp_extract(_whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def unescaped(text: Column) -> Column:
    """Escapes of letters, digits and ``._~-`` become these characters, other ones upper case; once, from left to right."""

    def part(p: Column, k: Column) -> Column:
        letter = F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("long"))
        rest = F.substr(p, F.lit(3))
        known = F.when(letter.rlike("^[A-Za-z0-9._~-]$"), F.concat(letter, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))
        return F.when(k == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), p))

    return F.when(text.contains("%"), F.array_join(F.transform(F.split(text, "%"), part), "")).otherwise(text)


def canonical_host(host: Column) -> Column:
    """A host without user, port and dots at its end, unescaped, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")
    return F.regexp_replace(_lower(unescaped(bare)), r"\.+\z", "")


def canonical_path(path: Column) -> Column:
    """A path unescaped and without the segments . and .."""
    clear = unescaped(path)
    segments = F.split(clear, "/")
    step = lambda a, s: F.when(s == ".", a).when(s == "..", F.regexp_replace(a, r"/[^/]*\z", "")).otherwise(F.concat(a, F.lit("/"), s))
    folded = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.lit(""), step)
    folder = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.when(clear.contains("/."), F.concat(folded, folder)).otherwise(clear)


def _two_hashes(entry: Column) -> tuple[Column, Column]:
    return F.xxhash64(entry), F.xxhash64(F.concat(F.lit("2:"), entry))


class BlockedBloom:
    """Bits of a list's entries: each entry has one block, and in it one bit of each of eight words."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, lanes) of uint64

    @classmethod
    def build(cls, entries: DataFrame, column: str, bits_per_entry: int = 16, most_bytes: int = MOST_BYTES) -> BlockedBloom:
        """Each block is a pre-aggregated bit_or; the driver gets the blocks, whose bytes most_bytes bounds."""
        n = max(1, entries.count())
        blocks = max(1, min(-(-n * bits_per_entry // 512), most_bytes // 64))
        h, g = _two_hashes(F.col(column))
        lanes = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(g, {6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(_LANES)]
        rows = entries.select(F.pmod(h, F.lit(blocks)).alias("block"), g.alias("g")).groupBy("block").agg(*lanes).toArrow()
        words = np.zeros((blocks, _LANES), dtype=np.int64)
        words[rows.column(0).to_numpy()] = np.stack([rows.column(1 + i).to_numpy() for i in range(_LANES)], axis=1)
        return cls(words.view(np.uint64))

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """For pairs of hashes (int64): False only if the entry isn't in the list."""
        block = self.words[np.mod(h, len(self.words))]
        g, found = g.view(np.uint64), np.ones(len(h), dtype=bool)
        for i in range(_LANES):
            bit = (g >> np.uint64(6 * i)) & np.uint64(63)
            found &= (block[:, i] >> bit) & np.uint64(1) == 1
        return found


def _fitting(places: DataFrame, listed: DataFrame, canonical: bool) -> DataFrame:
    """(host, path, entry, verdict) of different (host, path) that an entry of the list fits: the longest one."""
    known = listed.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    if canonical:
        known = known.select(canonical_host(F.col("host")).alias("host"), canonical_path(F.col("path")).alias("path"), "verdict")
    exact = known.groupBy(F.concat("host", "path").alias("entry"), F.col("host").alias("entry_host")).agg(F.max("verdict").alias("verdict"))
    filt = BlockedBloom.build(exact, "entry")
    shared = places.sparkSession.sparkContext.broadcast(filt.words)
    lengths = sorted(r[0] for r in known.select(F.length("path")).distinct().collect())
    lengths_of = F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>")

    @F.pandas_udf("array<boolean>")
    def possible(h: pd.Series, g: pd.Series) -> pd.Series:
        sizes = h.map(len).to_numpy()
        if not sizes.sum():
            return h.map(lambda x: [])
        hit = BlockedBloom(shared.value).holds(np.concatenate(h.to_list()).astype(np.int64), np.concatenate(g.to_list()).astype(np.int64))
        return pd.Series([x.tolist() for x in np.split(hit, np.cumsum(sizes)[:-1])])

    clear = places.select("host", "path", (canonical_host if canonical else lambda c: c)(F.col("host")).alias("h"), (canonical_path if canonical else lambda c: c)(F.col("path")).alias("p"))
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths_of, lambda n: n <= F.length("p")), lambda n: F.substr("p", F.lit(1), n))
    tried = clear.withColumn("tried", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    hashed = tried.withColumns({"one": F.transform("tried", lambda e: _two_hashes(e)[0]), "two": F.transform("tried", lambda e: _two_hashes(e)[1])})
    hit = hashed.withColumn("possible", possible("one", "two"))
    some = F.filter(F.zip_with("tried", "possible", lambda e, ok: F.when(ok, e)), lambda e: e.isNotNull())
    found = hit.select("host", "path", "h", F.explode(some).alias("entry")).join(exact, "entry").where("entry_host = h or endswith(h, concat('.', entry_host))")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("entry", "verdict"), F.struct(F.length("entry"), F.length("entry_host"))).alias("best"))
    return best.select("host", "path", "best.entry", "best.verdict")


def _placed(urls: DataFrame, url: str, replaced: tuple[str, ...]) -> DataFrame:
    return urls.select(*map(named, urls.drop("host", "path", *replaced).columns), host_of(url).alias("host"), path_of(url).alias("path"))


def judge(urls: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", canonical: bool = True) -> DataFrame:
    """urls with host, path, entry (the longest listed prefix that fits, as host/path; else null) and verdict.

    listed: host, path, verdict. An entry fits its host and all subdomains if the url's
    path starts with the entry's; of those that fit, the longest host + path wins (of
    equally long ones, that with the longer host). Without a fitting entry the verdict is
    default. canonical: urls and entries are compared without user, port, dots at the host's
    end, dot segments and needless escapes; host and path remain as they were written.

    Each url is judged once however many rows have it: its candidates (host suffixes at
    dots x path prefixes of lengths that the list has) are tested against the Bloom filter;
    the hits alone reach the hash join with the list, which removes false positives.

    Null url or one without ://: host and path are empty, and only an entry with an empty
    host could fit. Null host or path of an entry: empty. An entry listed with several
    verdicts has the last of them by the alphabet (block rather than allow). Repeated rows
    stay. An empty list or table works. Columns host, path, entry and verdict of urls are
    replaced, any other kept, whatever its name.
    """
    rows = _placed(urls, url, ("entry", "verdict"))
    fits = _fitting(rows.select("host", "path").distinct(), listed, canonical)
    return rows.join(fits, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def judge_by_rules(urls: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict by two lists: the longest rule that fits urls as written decides and is named; else the listed entry that fits as in judge(); else default.

    Columns host, path, rule and verdict of urls are replaced, any other kept.
    """
    rows, mark = _placed(urls, url, ("rule", "verdict")), mark_for(urls)
    places = rows.select("host", "path").distinct()
    ruled = _fitting(places, rules, False).withColumnsRenamed({"entry": "rule", "verdict": f"{mark}ruled"})
    met = _fitting(places, listed, True).select("host", "path", F.col("verdict").alias(f"{mark}listed"))
    both = rows.join(ruled, ["host", "path"], "left").join(met, ["host", "path"], "left")
    return both.withColumn("verdict", F.coalesce(f"{mark}ruled", f"{mark}listed", F.lit(default))).drop(f"{mark}ruled", f"{mark}listed")


def listing(spark: SparkSession, entries: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A list (host, path, verdict) given by hand."""
    return spark.createDataFrame(list(entries), "host string, path string, verdict string")


def read_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A list (host, path, verdict) kept as Parquet, of any size."""
    return spark.read.parquet(folder).select("host", "path", "verdict")
