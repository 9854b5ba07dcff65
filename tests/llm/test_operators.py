"""Operators against brute force, and their defined results for odd tables."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstone.llm import common, embedding_dedup, line_dedup, minhash, packing, quality_rules, sentencepiece_fst, sharding, token_counts, url_filter, warc

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    return " ".join(np.random.default_rng(seed).choice([f"w{k}" for k in range(5000)], n))


BASE = words(1, 400)
NEAR = BASE.replace(BASE.split()[200], "changed", 1)
LONG = "\n".join(words(k, 30) for k in range(600))
TEXTS = [BASE, BASE, NEAR, words(2, 400), "", None, "one two", "one two", LONG, " \n\t ", "a  b\n\n\nc <|endoftext|> é 日本 😀", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}" if k != 7 else None, 0) for k, t in enumerate(TEXTS)] + [(None, BASE, None, None, None), (3, TEXTS[3], "en", "s0", 0)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_sharding_law_and_mixture(spark, docs, empty):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = sharding.interleave(rows, 16).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    hot = got[got.source == "hot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 2
    odd = sharding.interleave(docs.withColumn("shard", F.lit("x")).select("doc_id", "source", "shard"), 4)
    assert odd.count() == docs.count() and dict(odd.dtypes)["shard"] == "int"
    assert sharding.interleave(empty, 4).count() == 0


def test_sharding_with_many_ranges(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("source"))
    whole = sharding.interleave(rows, 8).orderBy("doc_id").collect()
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    assert sharding.interleave(rows, 8).orderBy("doc_id").collect() == whole


def test_url_filter_against_prefixes(spark):
    urls = ["http://a.example.com/en/x?q#f", "HTTP://WWW.Example.com/en/1", "https://x.net/es/", "https://x.net/esx", "ftp://notnet/fr/", "no scheme", None, "", "http://net/fr/a/b", "http://b.co.org", "http://sub.b.co.org:80/", "x://y://z/en/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls + urls[:2])], "page_id long, url string, host string")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("co.org", "", "block")]
    got = {r.page_id: (r.entry, r.verdict) for r in url_filter.judge(pages, url_filter.listing(spark, rules), canonical=False).collect()}
    for k, u in enumerate(urls + urls[:2]):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (max(fits)[2:] if fits else (None, "allow")), u
    assert url_filter.judge(pages.limit(0), url_filter.listing(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.listing(spark, [])).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("e"))
    bloom = url_filter.BlockedBloom.build(listed, "e")
    tried = spark.range(20000).select(F.xxhash64(F.concat(F.lit("h"), "id")).alias("h"), F.xxhash64(F.concat(F.lit("2:h"), "id")).alias("g")).toPandas()
    hit = bloom.holds(tried.h.to_numpy(), tried.g.to_numpy())
    assert hit[:2000].all() and hit[2000:].mean() < 0.02


def test_minhash_groups(spark, docs, empty):
    got = collections.defaultdict(set)
    for r in minhash.classes(docs).collect():
        got[r.doc_id].add(r.class_id)
    assert got[0] == got[1] == got[2] == got[None] == {0}
    assert got[3] == {3} and got[6] == got[7] == {6} and got[4] == got[5] == {4} and got[9] == {9} and got[8] == {8}
    kept = minhash.one_of_each(docs.withColumn("class_id", F.lit("clash")))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 6, 8, 9, 10, 11] and "class_id" in kept.columns
    assert minhash.classes(empty).count() == 0


def test_minhash_finds_pairs_of_brute_force(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(30):
        base = words(100 + g, 300).split()
        for c in range(4):
            copy = list(base)
            for k in rng.choice(300, 1 + c, replace=False):
                copy[k] = f"new{g}-{c}-{k}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    cls = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(rows, DOC)).collect()}

    def shingled(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = [shingled(r[1]) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert j < 0.82 or cls[a] == cls[b]
            assert a // 4 == b // 4 or cls[a] != cls[b]


@pytest.mark.parametrize("block_texts", [512, 16])
def test_minhash_loses_no_link_of_a_key(spark, monkeypatch, block_texts):
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block_texts, raising=False)
    rng, rows = np.random.default_rng(8), []
    for g in range(4):
        base = words(900 + g, 120).split()
        for c in range(150):
            copy = list(base)
            for k in rng.choice(120, rng.integers(2, 5), replace=False):
                copy[k] = f"new{g}-{c}-{k}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOC)
    counts, n = minhash.document_frequencies(docs)
    idf = minhash.idf_of(counts, n)
    sets = []
    for r in rows:
        data = np.frombuffer(r[1].encode(), np.uint8)
        sets.append(minhash.weighted(common.word_hashes(data, np.array([len(data)]))[0], idf))
    starts = np.cumsum([0, *(len(x[0]) for x in sets[:-1])])
    samples = minhash.Sampler()(np.concatenate([x[0] for x in sets]), np.concatenate([x[1] for x in sets]), starts)
    keys, marks = minhash.band_keys(samples), (samples >> np.uint64(56)).astype(np.uint8)
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in np.flatnonzero((keys[:a] == keys[a]).any(axis=1) & ((marks[:a] == marks[a]).sum(axis=1) >= minhash.least_agreement(0.8))):
            if want[a] != want[b] and minhash.similarity(sets[a], sets[b]) >= 0.8:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert 4 < len(set(want)) < len(rows) - 40 and [got[k] for k in range(len(rows))] == want


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**63, 600, dtype=np.uint64))
    w = rng.uniform(0.5, 3, 600)
    a, b = (h[:450], w[:450]), (h[150:], w[150:] * 1.2)
    s = minhash.Sampler(samples=2000)
    x, y = (s(p[0], p[1], np.array([0]))[0] for p in (a, b))
    assert (x == y).mean() == pytest.approx(minhash.similarity(a, b), abs=0.04)


def stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = collections.Counter(runs)
    covered = {k + j for k, run in enumerate(runs) if often[run] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_statistics_equal_brute_force(spark, empty):
    texts = [*TEXTS, "a b c d e f a b c d e g\na b c d e\n\na b c d e", "#1 *2 $% &|<> #1", "l\nl\nl\n m \n m ", "q " * 40, "ab\x0bcd\x0cef\rgh"]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.with_statistics(rows).collect()}
    assert got == {k: stats(t) for k, t in enumerate(texts)}
    assert quality_rules.judge(empty, []).count() == 0


def test_labelled_ids_teach_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_rules, "learn", lambda rows: seen.append(rows) or [])
    text = words(3, 60)
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(1, 1), (2, 1)], "doc_id long, quality int")
    once = spark.createDataFrame([(k, f"{text} {'x' * (k + 1)}") for k in range(12)], "doc_id long, text string")
    hot = once.union(once.where("doc_id = 1").crossJoin(spark.range(500)).select("doc_id", F.concat("text", F.lit(" longer"), F.repeat(F.lit("y"), F.col("id").cast("int"))).alias("text")))
    for rows in (once, hot, hot.union(hot)):
        quality_rules.fit(rows, labels)
    assert len(seen[0]) == len(seen[1]) == 11 and seen[1] == seen[2]
    quality_rules.fit(hot, labels, most=4)
    assert len(seen[3]) == 4


def test_decision_list_learns_a_conjunction():
    rng, rows = np.random.default_rng(0), []
    for _ in range(1500):
        r = {f: float(rng.random()) for f in quality_rules.FEATURES}
        rows.append((r, r["symbol_share"] > 0.7 and r["mean_word"] <= 0.5))
    rules = quality_rules.learn(rows[:1000])
    wrong = sum(any(quality_rules._holds(r, rule.tests) for rule in rules) != bad for r, bad in rows[1000:])
    assert rules and wrong <= 10
    assert quality_rules.learn([(r, False) for r, _ in rows[:50]]) == []


def test_token_counts_equal_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, cache = Tokenizer.from_file(path), token_counts.own_cache(spark)
    want = collections.Counter((k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in [*enumerate(TEXTS), (None, BASE), (3, TEXTS[3])])
    for _ in range(2):  # the second time all counts are stored
        got = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path, cache)
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()
    assert token_counts.count_tokens(empty, path, cache).count() == 0


ODD = ["", "a", " a", "a ", "a  b", "a\nb", "\na", "a\n\nb", "a \n b", "a\n\n\nb\n\n", " \n x", "it's 'Re'x <|endoftext|> x", "日本語 テスト　x", "é ÀÉ İ ΑΣ. ß", "▁x ▁▁ y", "\x1ca\x85b\xa0c", "a\tb\t\nc", "  x   y  ", "😀 x😀\n😀", "\n\n", "  ", "don't  stop\r\n\r\nnow", "12345 6 ½", "Zażółć gęślą jaźń"]


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteTokenizer(path)
    for t in ODD + [t for t in TEXTS if t]:
        assert np.frombuffer(own(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pack_places_each_id_once(spark, docs, empty):
    path = P.path("byte_bpe_50k.json")
    own = packing.ByteTokenizer(path)
    rows = packing.pack(docs.coalesce(1), path).collect()
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    for k, t in enumerate(TEXTS):
        if k != 3:  # met twice
            parts = sorted(by[k], key=lambda r: r.start)
            assert b"".join(bytes(r.ids) for r in parts) == own(t or "") + b"\0" * 4
            assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
    for parts in windows.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert sum(r.length for r in parts) <= 1024
    total = sum(r.length for r in rows)
    assert len(windows) <= -(-total // 1024) + 2
    assert packing.pack(empty, path).count() == 0


def test_differencing_is_near_equal_and_raises_the_count():
    sizes = [int(x) for x in np.random.default_rng(4).integers(1, 257, 200)]
    sets = packing.difference(sizes, 20)
    sums = [sum(sizes[k] for k in s) for s in sets]
    assert sorted(k for s in sets for k in s) == list(range(200)) and max(sums) - min(sums) <= 5
    assert len(packing.balanced([600, 600, 600])) == 3


def test_sentencepiece_equals_the_library(spark, docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)
    for t in ODD + [t for t in TEXTS if t]:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t
        assert own.decode(ids) == library.decode(library.encode(t)), t
    back = sentencepiece_fst.round_trip(docs, path)
    assert all(r.decoded == TEXTS[r.doc_id or 0] or not TEXTS[r.doc_id or 0] for r in back.collect())
    coded = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, path), path, text="again").where("not text <=> again")
    assert coded.count() == 0 and sentencepiece_fst.round_trip(empty, path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>same</p>", "<p>same</p>", "", None, words(9, 3000), "ünï\r\n\r\n"]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h) for k, h in enumerate(html)] + [(None, None, "lone")] + [(50 + k, "http://y/\n", words(k, 50)) for k in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    warc.write(pages, folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert len(got) == 47
    assert got[0].record_type == "revisit" and got[0].refers_to == 1 and got[1].record_type == "response"
    assert got[2].refers_to == 3 and got[3].payload_bytes == 0 and got[None].record_type == "response"
    assert bytes(got[4].payload).decode() == html[4] and bytes(got[5].payload).decode() == html[5]
    assert got[1].payload_digest == got[0].payload_digest == warc.payload_digest(b"<p>same</p>")
    names = warc.export(spark, folder, str(tmp_path))
    assert names and sum(len(list(warc.read_records((tmp_path / n).read_bytes()))) for n in names) == 47
    warc.write(pages.limit(0), folder + "-empty")
    assert warc.read(spark, folder + "-empty").count() == 0


@pytest.mark.parametrize("task_rows", [100_000, 100])
def test_components_equal_union_find(spark, monkeypatch, task_rows):
    monkeypatch.setattr(common, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    root = {k: k for p in pairs for k in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = common.components(spark.createDataFrame([*pairs, (5, 5), (None, 1)], "a long, b long"))
    linked = {k for a, b in pairs if a != b for k in (a, b)}
    assert {r.node: r.component for r in got.collect()} == {k: root[k] for k in linked} and got.count() == len(linked)
    assert common.components(got.limit(0).toDF("a", "b")).count() == 0


def test_embedding_components_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base + 0.02 * rng.standard_normal((40, 16)) for _ in range(5)] + [base[:3] * 2, base[:3]]).astype(np.float32)
    rows = [(k, [float(e) for e in v], "x") for k, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, [1.0, 2.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows + [(a, b, "x") for a, b in odd], "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    for k in range(len(x)):
        assert got[k].component_id == min(np.flatnonzero(near[k])) and got[k].n_links == near[k].sum() - 1
        assert got[k].kept == (got[k].component_id == k)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (900, 901, 902, 903, 904))
    assert got[905].n_links == 1 and got[None].component_id == 905
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [8192, 100])
def test_embedding_links_of_a_large_group_are_all_counted(spark, monkeypatch, block_rows):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", block_rows, raising=False)
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(16) + 0.2 * rng.standard_normal((600, 16))
    x = np.concatenate([hot, hot[:3], rng.standard_normal((200, 16))]).astype(np.float32)
    df = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in enumerate(x)] + [(5000, [1.0] * 3), (5001, [1.0, 1.0, 1.01])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.dedup(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    low = np.arange(len(x))
    for _ in range(20):
        low = np.array([low[row].min() for row in near])
    assert 50 < near.sum(axis=1).max() and [got[k].n_links for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert [got[k].component_id for k in range(len(x))] == low.tolist() and got[5001].component_id == 5000


def test_line_dedup_equals_brute_force(spark, empty):
    rows = [(k, f"intro line {k} here\nshared by all sites\nshort\nseen on {k % 9} of nine sites", "en", f"s{k % 12}", 0) for k in range(36)] + [(100, None, "en", "s1", 0), (101, "", None, None, None), (1, "again shared by\nshared by all sites", "en", "s3", 0)]
    got = line_dedup.clean(spark.createDataFrame(rows, DOC).withColumn("n_lines", F.lit("clash"))).collect()
    sites, owner = collections.defaultdict(set), {}
    for k, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            sites[line].add(s)
            owner[line] = min(k, owner.get(line, k))
    bad = {x for x in sites if len(sites[x]) >= line_dedup.LEAST_SITES and x.strip(" \t\n\x0b\x0c\r")}
    want = sorted(((k, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad or owner[x] == k)) for k, t, *_ in rows), key=repr)
    assert bad and sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    assert line_dedup.clean(empty).count() == 0


def test_crc_of_pieces_is_of_their_bytes(spark):
    row = spark.createDataFrame([(b"\x01\0\0\0",)], "ids binary").select(F.crc32("ids")).first()
    assert row[0] == zlib.crc32(b"\x01\0\0\0")
