"""Extra columns with clashing names come back unchanged; odd tables have defined results."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.llm import common, embedding_dedup, line_dedup, minhash, packing, quality_rules, sentencepiece_fst, sharding, token_counts, url_filter, warc
from tests.llm.test_operators import DOC, P, TEXTS, words

#: Names that operators use or used inside, and names that need quotes.
ODD = ["_t", "_h", "_w", "_l", "_at", "_node", "_class", "_label", "_key", "_source", "_range", "_n", "_fraction", "_content", "_left", "_bad", "_mine", "__node", "ruled", "best", "node", "label", "h", "n", "key", "side", "a.b", "two words"]


def odd(df):
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(df.columns[0], F.lit(-1)).cast("string")).alias(c) for c in ODD])


def unchanged(found, id_column="doc_id"):
    assert set(ODD) <= set(found.columns) and len(found.columns) == len(set(found.columns))
    for r in found.collect():
        name = -1 if r[id_column] is None else r[id_column]
        assert [r[c] for c in ODD] == [f"{c}:{name}" for c in ODD]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k != 7 else None, 0) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, None)]
    rows += [(100 + k, f"on every site\n{words(k, 20)}", "en", f"t{k}", 0) for k in range(9)]
    return odd(spark.createDataFrame(rows, DOC))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: sharding.interleave(d, 4),
        lambda d: minhash.one_of_each(d),
        lambda d: quality_rules.judge(d, []),
        lambda d: token_counts.count_tokens(d, P.path("word_bpe_49k.json"), token_counts.own_cache(d.sparkSession)),
        lambda d: line_dedup.clean(d),
        lambda d: sentencepiece_fst.decode(sentencepiece_fst.encode(d, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model"), text="again"),
    ],
    ids=["sharding", "minhash", "quality_rules", "token_counts", "line_dedup", "sentencepiece"],
)
def test_documents_keep_extra_columns(docs, run):
    unchanged(run(docs))
    assert run(docs.limit(0)).count() == 0


def test_urls_keep_extra_columns(spark):
    pages = odd(spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, None), (3, "http://b.net/" + "p/" * 50_000)], "page_id long, url string"))
    rules = url_filter.listing(spark, [("com", "/", "allow"), ("b.net", "/p", "block")])
    unchanged(url_filter.judge(pages, rules), "page_id")
    unchanged(url_filter.judge_by_rules(pages.withColumn("entry", F.lit("kept")), rules, rules), "page_id")
    got = {r.page_id: (r.rule, r.verdict, r.entry) for r in url_filter.judge_by_rules(pages.withColumn("entry", F.lit("kept")), rules, rules).collect()}
    assert got == {1: ("com/", "allow", "kept"), 2: (None, "allow", "kept"), 3: ("b.net/p", "block", "kept")}


def test_operators_that_leave_extra_columns_out(spark, docs):
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"))
    assert pieces.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert pieces.where("doc_id is null").agg(F.sum("length")).first()[0] > 1
    back = sentencepiece_fst.round_trip(docs, P.path("piece_bpe_32k.model"))
    assert back.columns == ["doc_id", "ids", "decoded"] and back.where("doc_id is null").first().decoded == TEXTS[0]
    assert minhash.classes(docs).columns == ["doc_id", "class_id", "kept"]
    vectors = odd(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(vectors).collect()) == [(0, 1, 1, False), (1, 1, 1, True)]


# ---------------------------------------------------------------- URLs

CANONICAL = ["http://bad.com:80/x", "http://bad.com./x", "http://u@bad.com/x", "http://bad.com/%78", "http://bad.com/a/../x", "http://BAD.com:/./x", "http://u:p@sub.b%61d.com..:8080/y/%2e%2E/x/z"]
CLEAR = ["http://bad.com/%2578", "http://bad.com/y", "http://bad.com.org/x", "http://notbad.com/x", "http://bad.com/a/x", "http://bad.com/x/..", "http://bad.com/%zz", "http://bad.com/%"]


def test_canonical_urls_are_caught(spark):
    listed = url_filter.listing(spark, [("Bad.com.", "/./x", "block"), ("bad.com", "/x", "allow")])
    pages = spark.createDataFrame(list(enumerate(CANONICAL + CLEAR)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_filter.judge(pages, listed).collect()}
    assert got == {u: "block" for u in CANONICAL} | {u: "allow" for u in CLEAR}
    plain = {r.url for r in url_filter.judge(pages, listed.where("path = '/x'"), canonical=False).where("entry is not null").collect()}
    assert not plain & set(CANONICAL)


def test_a_list_is_read_from_a_table(spark, tmp_path):
    url_filter.listing(spark, [("bad.com", "", "block")]).write.parquet(f"{tmp_path}/list")
    pages = spark.createDataFrame([(1, "http://x.bad.com/")], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.read_listing(spark, f"{tmp_path}/list")).first().verdict == "block"


# ---------------------------------------------------------------- token counts


@pytest.mark.parametrize("most", [500_000, 0])
def test_each_content_is_encoded_once(spark, docs, monkeypatch, most, tmp_path):
    monkeypatch.setattr(token_counts, "MOST_LISTED", most)
    seen = f"{tmp_path}/seen"
    inner = token_counts.ChunkCounter.__call__

    def noted(self, text):
        with open(seen, "a") as f:
            f.write(repr(text) + "\n")
        return inner(self, text)

    path, cache = P.path("word_bpe_49k.json"), token_counts.own_cache(spark)
    rows = docs.union(docs).union(docs).repartition(7)
    monkeypatch.setattr(token_counts, "counter", lambda p: (lambda c: lambda t: noted(c, t))(token_counts.ChunkCounter(p)))
    assert token_counts.count_tokens(rows, path, cache).count() == rows.count()
    lines = collections.Counter(open(seen).read().splitlines())
    contents = {" ".join((t or "").split()) for t in [*TEXTS, *(f"on every site\n{words(k, 20)}" for k in range(9))]}
    assert len(lines) == len(contents) and set(lines.values()) == {1}
    more = rows.union(rows.where("doc_id = 3").withColumn("text", F.lit("two more words")).limit(2)).union(rows.where("doc_id = 3").limit(1).withColumn("text", F.lit("one more")))
    assert token_counts.count_tokens(more, path, cache).count() == more.count()
    lines = collections.Counter(open(seen).read().splitlines())
    assert len(lines) == len(contents) + 2 and set(lines.values()) == {1}


# ---------------------------------------------------------------- WARC


@pytest.mark.parametrize("most", [500_000, 0])
def test_warc_of_repeated_and_large_pages(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(warc, "MOST_REPEATED", most)
    large = "<p>" + words(4, 400_000)
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, "u", large), (4, "v", large), (None, "w", "same"), (None, None, None)]
    folder = f"file://{tmp_path}/a{most}"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder).collect())
    n = len(large.encode())
    assert got == collections.Counter([(1, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, n), (4, "response", None, n), (None, "revisit", 2, 4), (None, "response", None, 0)])
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder + "-least", least_bytes=5)
    kinds = collections.Counter((r.payload_bytes, r.record_type) for r in warc.read(spark, folder + "-least").collect())
    assert kinds == {(4, "response"): 5, (n, "response"): 1, (n, "revisit"): 1, (0, "response"): 1}


def test_archives_are_saved_by_tasks(spark, tmp_path):
    rows = [(k, f"http://x/{k}", words(k, 300)) for k in range(50)]
    folder, names = f"file://{tmp_path}/a", {}
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), folder)
    for by_tasks in (False, True):
        to = tmp_path / str(by_tasks)
        to.mkdir()
        names[by_tasks] = sorted(warc.export(spark, folder, str(to), by_tasks))
        assert sorted(p.name for p in to.iterdir()) == names[by_tasks]
        assert sum(len(list(warc.read_records(p.read_bytes()))) for p in to.iterdir()) == 50
    assert names[False] == names[True] and len(names[True]) >= 4


# ---------------------------------------------------------------- embeddings


def _clouds(kind, n, rng, dim=64):
    if kind == "lone pairs":
        base = rng.standard_normal((n // 2, dim))
        noise = rng.standard_normal((n // 2, dim))
        u = base / np.linalg.norm(base, axis=1, keepdims=True)
        v = noise - (noise * u).sum(axis=1, keepdims=True) * u
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return np.concatenate([u, 0.951 * u + np.sqrt(1 - 0.951**2) * v])  # each pair just above the threshold
    if kind == "hot topic":  # a third of all around one direction, too far apart to link but for pairs among them
        u = 0.8 * rng.standard_normal(dim) + 0.8 * rng.standard_normal((n // 3, dim))
        return np.concatenate([u, u[: n // 6] + 0.22 * rng.standard_normal((n // 6, dim)), rng.standard_normal((n // 2, dim))])
    hot = rng.standard_normal(dim) + 0.18 * rng.standard_normal((n // 3, dim))
    return np.concatenate([hot, rng.standard_normal((n - n // 3, dim))])


@pytest.mark.parametrize(("kind", "n", "tasks"), [("lone pairs", 6000, 1 << 16), ("lone pairs", 6000, 500), ("hot topic", 9000, 1 << 16), ("hot topic", 9000, 500), ("hot", 3000, 1 << 16), ("hot", 3000, 300)])
def test_embedding_recall_against_brute_force(spark, monkeypatch, kind, n, tasks):
    monkeypatch.setattr(embedding_dedup, "TASK_ROWS", tasks)
    x = _clouds(kind, n, np.random.default_rng(n)).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embedding_dedup.dedup(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and want.sum() > 1000 and found.sum() >= 0.99 * want.sum()


def test_more_vectors_need_more_passes():
    sizes = [embedding_dedup.passes_for(n, 0.95) for n in (0, 500, 10**4, 10**6, 10**8)]
    assert sizes == sorted(sizes) and sizes[0] >= 2 and sizes[-1] > 2 * sizes[2]


# ---------------------------------------------------------------- shared folder, settled tables


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_discarded_tables_go(spark):
    from pathlib import Path

    table, n = common.settled(spark.range(10))
    folder = Path(table.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert n == 10 and folder.is_dir()
    common.discard(table)
    assert not folder.exists()
