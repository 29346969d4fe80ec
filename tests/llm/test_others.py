import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skyadjust.llm import fingerprint, mixing, quality, queries, sharding, urlfilter, warc

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, type string").repartition(2)


def test_warc_round_trip(spark, tmp_path):
    big, odd = "<p>é\r\n\r\nWARC/1.1\r\n" * 90, "\r\n\r\n" * 3
    rows = [(1, "http://a/x y", big, "", ""), (2, None, big, "", ""), (3, "u", odd, "", ""), (4, "http://b", None, "", ""), (5, "http://c#f", "", "", ""), (6, "http://d", big, "", ""), (7, "h", odd, "", "")]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows), path, captures_per_file=2)
    got = {r["capture_id"]: r for r in warc.assemble(warc.read(spark, path)).collect()}
    assert len(got) == 7
    for page_id, _, html, *_ in rows:
        kind = "revisit" if page_id in (1, 2) else "response"
        r = got[f"<urn:page:{page_id}:{kind}>"]
        payload = (html or "").encode()
        assert r["response"]["payload_digest"] == hashlib.sha1(payload).hexdigest() and r["response"]["payload_bytes"] == len(payload)
        assert r["response"]["refers_to"] == ("<urn:page:6:response>" if kind == "revisit" else None)
        if kind == "response":
            assert bytes(r["response"]["payload"]) == payload
        assert len(r["requests"]) == len(r["metadata"]) == 1


def test_warc_every_row_is_a_capture(spark, tmp_path):
    big = "<p>text " * 200
    rows = [(1, "a", "x", "", ""), (1, "b", "y", "", ""), (1, "b", "y", "", ""), (None, "c", "z", "", ""), (None, None, big, "", ""), (2, "d", big, "", ""), (3, "e", big, "", ""), (3, "e", big, "", "")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_warc_transactions(spark, str(tmp_path)).collect()
    kinds = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"], r["n_requests"], r["n_metadata"]) for r in got)
    n = len(big)
    assert kinds == [(0, 1, "response", None, 1, 1), (0, n, "response", None, 1, 1), *[(1, 1, "response", None, 1, 1)] * 3, (2, n, "revisit", 3, 1, 1), *[(3, n, "response", None, 1, 1)] * 2]


def test_warc_transactions_through_other_records_and_orphans(spark):
    row = lambda i, t, to: (i, t, None, None, to, None, None, None, None)
    rows = [row("r", "response", ["q"]), row("q", "request", []), row("m", "metadata", ["q"]), row("lone", "metadata", ["gone"]), row("r", "response", ["q"])]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert set(got) == {"r", "lone"}
    assert [x["record_id"] for x in got["r"]["requests"]] == ["q"] and [x["record_id"] for x in got["r"]["metadata"]] == ["m"]
    assert got["lone"]["response"] is None


def test_warc_parser_takes_gzip_and_refuses_cut_records():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nX: one\r\n two\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    got = list(warc.parse(gzip.compress(record) + gzip.compress(record)))
    assert [bytes(b) for _, b in got] == [b"hello"] * 2 and got[0][0]["x"] == ["one two"]
    with pytest.raises(ValueError):
        list(warc.parse(record[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense"))


def test_warc_empty_table(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "w"))
    assert warc.assemble(warc.read(spark, str(tmp_path / "w"), payload=False)).count() == 0


# Fingerprints


def test_fingerprints_of_edits(make_docs, prose):
    rows = [(i * 3, t) for i, t in enumerate(ODD_TEXTS)] + [(1000 + i, prose(i, 30 + 40 * i)) for i in range(10)] + [(2000, prose(1, 500)), (2001, prose(1, 500))]
    got = {r["doc_id"]: r for r in fingerprint.compare_edits(make_docs(rows), block_rows=4).collect()}
    texts = [t or "" for _, t in rows]
    digests = lambda t: set(fingerprint.paragraph_digests([t])[1].tolist())
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(like(digests(t), digests(edited)))
        assert got[i]["near_next"] == pytest.approx(like(digests(t), digests(nxt)))
    assert got[2000]["fingerprint"] == got[2001]["fingerprint"] and got[2000]["near_next"] == 1.0


def test_fingerprint_small_tables(make_docs):
    only = fingerprint.compare_edits(make_docs([(7, "just one text here")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0
    assert fingerprint.compare_edits(make_docs([])).count() == 0
    assert len(fingerprint.compare_edits(make_docs([(1, "a"), (1, "a"), (1, "b"), (None, "c")])).collect()) == 4
    assert {r["n_chars"] for r in fingerprint.fingerprint(make_docs([(1, None), (2, "abc")])).collect()} == {0, 3}


def test_peeling_recovers_the_difference_after_retries():
    rng = np.random.default_rng(2)
    a, b, both = (rng.integers(1, 1 << 63, n).astype(np.uint64) for n in (700, 300, 2000))
    s, t = (fingerprint.Sketches(1, 6000) for _ in range(2))
    for sk, extra in ((s, a), (t, b)):
        d = np.concatenate([extra, both])
        sk.add(np.zeros(len(d), np.int64), d, 1)
    s.subtract(t)
    _, digest, sign, full = s.peel()
    assert full.all() and set(digest[sign == 1].tolist()) == set(a.tolist()) and set(digest[sign == -1].tolist()) == set(b.tolist())
    small = fingerprint.Sketches(1, fingerprint.CELLS)
    small.add(np.zeros(700, np.int64), a, 1)
    assert not small.peel()[3].any()


# Mixing


def test_targets_fill_to_the_caps():
    t = mixing.targets([("a", 100), ("b", 100), (None, 1000)], (3, 1, 2), 1.5, 2.0)
    assert t["a"] == 200 and t["b"] == 200 and t[None] == pytest.approx(1400)
    assert mixing.targets([], (3, 1, 2), 1.5, 2.0) == {}
    assert mixing.targets([("a", 0)], (3, 1, 2), 1.5, 2.0) == {"a": 0}


def test_mix_of_odd_rows(make_docs, prose):
    rows = [(i, prose(i, 5 + i % 50), ("b", "a", None)[i % 3]) for i in range(300)] + [(1000, None, "a"), (1001, "", "zero"), (5, prose(5, 10), "a"), (5, prose(5, 10), "a")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    for s in ("a", "b", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    assert mixing.mix(make_docs([])).count() == 0
    copies = sum(r["copies"] for r in got if r["doc_id"] not in (5,))
    assert mixing.apply(docs).where("doc_id != 5").count() == copies


# Quality


def test_quality_finds_junk_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = quality.train(docs, labels)
    got = quality.classify(docs, r).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    assert np.mean([x["predicted"] == x["quality"] for x in got]) > 0.9
    assert all((x["predicted"] == 1) == (x["score"] >= 0.3) and 0 <= x["score"] <= 1 for x in got)
    again = quality.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again.weight, r.weight)


def test_quality_of_odd_rows(spark, make_docs):
    rows = list(enumerate(ODD_TEXTS))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    keep_all = quality.train(make_docs(rows), none)
    got = quality.classify(make_docs(rows), keep_all).collect()
    assert len(got) == len(rows) and all(r["predicted"] == 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert quality.keep_good(make_docs(rows), keep_all).count() == len(rows)
    assert quality.classify(make_docs([]), keep_all).count() == 0
    with_null = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(make_docs(rows), with_null) is not None


def test_quality_threshold_is_the_quantile_of_all_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(label[r["doc_id"]], r["text"] or "") for r in docs.collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    r = quality.train(docs, labels, sample=120)
    raw = np.sort(r.raw(quality.features(pa.array([t for _, t in rows]))))
    k = sum(y == 0 for y, _ in rows)
    assert len(rows) > 200 and r.cut == pytest.approx((raw[k - 1] + raw[k]) / 2)
    assert quality.train(docs.repartition(7), labels.repartition(3), sample=120).cut == pytest.approx(r.cut, rel=1e-9)


def test_middle_equals_sorting(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=500), np.repeat(rng.normal(size=7), 40), np.array([1.0, 1.0, 1.0]), np.array([-3.0, 1e9, 1e9 + 1e-6])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        ordered = np.sort(values)
        for k in {1, len(values) // 2, len(values) - 1}:
            assert quality.middle(df, k, parts=8) == (ordered[k - 1] + ordered[k]) / 2


def test_quality_fit_is_the_optimum_of_plain_pairwise_loss(monkeypatch):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    x = rng.normal(size=(60, 4)) + y[:, None] * np.array([1.0, -0.5, 0.0, 2.0])
    monkeypatch.setattr(quality, "N_FEATURES", 4)
    r = quality.fit(x, y)
    z = (x - r.centre) / r.scale
    draw = np.random.default_rng(7)
    good, bad = [i for i in range(60) if y[i]], [i for i in range(60) if not y[i]]
    pairs = list(zip(draw.choice(good, quality.PAIRS), draw.choice(bad, quality.PAIRS), strict=True))

    def loss(w):
        s = z @ w
        return np.mean([np.log1p(np.exp(s[b] - s[g])) for g, b in pairs]) + 0.5e-3 * float(w @ w)

    best = loss(r.weight)
    for i in range(4):
        for step in (1e-3, -1e-3):
            assert loss(r.weight + step * np.eye(4)[i]) > best
    assert r.weight[3] > r.weight[0] > 0 > r.weight[1]


def test_quality_of_repeated_ids(spark, make_docs, prose):
    rows = [(i, prose(i, 40) if i % 2 else "$$ !! " * 30) for i in range(40)] + [(2, prose(99, 30))] * 25 + [(None, "no id")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2, "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    r, again = quality.train(docs, labels, sample=20), quality.train(docs.repartition(6), labels.repartition(2), sample=20)
    assert np.allclose(r.weight, again.weight) and r.cut == pytest.approx(again.cut)
    got = quality.classify(docs, r).collect()
    assert len(got) == len(rows) and len({x["score"] for x in got if x["doc_id"] == 2}) == 2


def test_features_do_not_depend_on_neighbours():
    texts = [t or "" for t in ODD_TEXTS]
    whole = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(pa.array([t]))[0])


# Sharding


def test_shards_are_even_and_keep_groups(make_docs, prose):
    rows = [(i, prose(i, 10 + i % 40)) for i in range(2000)] + [(3000 + i, prose(i % 20, 25)) for i in range(200)] + [(5000 + i, "hot text " * 10) for i in range(900)] + [(9000, None), (9001, ""), (9001, "")]
    got = sharding.shard(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in x) for x in by.values()]
    assert len(by) == 40 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    where = {r["doc_id"]: r for r in got}
    texts = dict(rows)
    assert all(where[i]["size"] == len((t or "").encode()) + 16 and where[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in texts.items())
    groups = {}
    for i in range(200):
        groups.setdefault(i % 20, set()).add(where[3000 + i]["shard"])
    assert sum(len(g) for g in groups.values()) <= 20 + 8
    hot = {where[5000 + i]["shard"] for i in range(900)}
    assert len(hot) < 40


def test_shards_against_a_plain_count(make_docs, prose):
    rows = [(i, prose(i % 300, 12 + i % 30)) for i in range(900)] + [(2000 + i, "copy") for i in range(400)] + [(None, "x"), (7, None), (7, "")]
    got = sharding.shard(make_docs(rows)).collect()
    key = lambda i, t: (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(key(i, t) for i, t in rows)
    total, load, slots, homes = sum(r["size"] for r in got), [0] * 40, [[] for _ in range(40)], {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    most = max(r["size"] for r in got)
    assert all(abs(n - total / 40) <= 2 * most for n in load) and all(sorted(s) == list(range(len(s))) for s in slots)
    # The line of labels has 39 cuts, each through one group at most; the large group has its own.
    assert sum(len(h) > 1 for h in homes.values()) <= 40


def test_shard_small_tables(make_docs):
    assert sharding.shard(make_docs([])).count() == 0
    one = sharding.shard(make_docs([(1, "a"), (2, "a"), (3, None)])).collect()
    assert len(one) == 3
    copies = sharding.shard(make_docs([(i, "same") for i in range(400)])).groupBy("shard").count().collect()
    assert len(copies) == 40 and {r["count"] for r in copies} == {10}


def test_cells_that_do_not_fit_keep_no_others_out(spark):
    from skyadjust.llm._common import Scratch

    rows = [(1, 0, 1, 0, 100, 0), (1, 0, 1, 1, 90, 1), (2, 0, 1, 0, 12, 0), (2, 0, 1, 1, 5, 1)]
    cells = spark.createDataFrame(rows, "g long, crc long, size long, c0 int, bytes long, shard int")
    got = {(r["g"], r["c0"]): r["shard"] for r in sharding.propagate(cells, 2, 120.0, Scratch(spark, "cells")).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (2, 0): 0, (2, 1): 0}


# URL filter


def test_url_rules_and_list(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://a.com/en/1", "http://com/en/", "http://xcom/en/1", "ftp://a.net/de/8", "http://example.net/de/8", "http://b.example.net/de/80", "https://x.org/es", "https://x.org/es/",
            "http://listed.example/p/", "https://www.listed.example/p?z", "http://listed.example/P", "http://u:1/en/://x", "http://h?x://a.com/en/", "http://é.com/en/ü\nz"]
    rows = [(i, u, "", "k", "r") for i, u in enumerate(urls)] + [(4, urls[4], "", "k", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key string, rule string")
    listed = spark.createDataFrame([("listed.example/p",), ("other/q",)], "key string")
    got = {}
    for r in urlfilter.judge(df, queries.RULES, listed).collect():
        got.setdefault(r["page_id"], []).append(tuple(r)[1:])
    assert len(got) == len(urls) and got[4] == [("www.example.com", "/en/7x", "example.com/en/7", "allow")] * 2
    for i in (0, 1, 2, 3):
        assert got[i] == [("", "", None, "allow")]
    verdicts = {i: got[i][0][2:] for i in got}
    assert verdicts[5] == ("com/en/", "block") and verdicts[6] == ("com/en/", "block") and verdicts[7] == (None, "allow")
    assert verdicts[8] == ("net/de/", "allow") and verdicts[9] == verdicts[10] == ("example.net/de/8", "block")
    assert verdicts[11] == (None, "allow") and verdicts[12] == ("org/es/", "block")
    assert verdicts[13] == verdicts[14] == (None, "block") and verdicts[15] == (None, "allow")
    assert got[17] == [("h", "", None, "allow")] and got[18][0][:2] == ("é.com", "/en/ü\nz")
    assert urlfilter.judge(df.limit(0), queries.RULES, listed).count() == 0
    assert urlfilter.judge(df, (), listed.limit(0)).where("verdict = 'block'").count() == 0


def test_url_of_many_labels_and_equally_long_rules(spark):
    deep = ".".join(["a"] * 3000) + ".example.com"
    rows = [(1, f"http://{deep}/en/7"), (2, f"http://{deep}.org/"), (3, "http://x.ab.cd/p"), *[(None, None)] * 50]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (*queries.RULES, ("block", "ab.cd/p"), ("allow", "cd/"), ("allow", "b.cd/p"))
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules, spark.createDataFrame([], "key string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "example.com/en/7", "allow"), (2, None, "allow"), (3, "ab.cd/p", "block"), *[(None, None, "allow")] * 50], key=str)


def test_bloom_lets_all_entries_pass(spark):
    entries = spark.range(500).selectExpr("concat('k', id) AS key", "id AS v")
    keys = spark.range(1500).selectExpr("concat('k', id) AS key")
    assert urlfilter.hits(keys, entries, 500).count() == 500
    made, blocks = urlfilter.bloom(entries, 500)
    assert blocks == 125 and made.count() <= 125


# Registered queries against their SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SF).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
