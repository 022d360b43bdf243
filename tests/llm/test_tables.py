"""WARC archives, nearest neighbours and the pipeline."""

import base64
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from attestor.llm import ann, warc
from attestor.llm.common import prepare
from pyspark.sql import functions as F


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(20), k=rng.randrange(9))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


PAGES = [(3, "http://b.com/x", "same"), (1, "http://a.com/ü y\r\nz?q#f", "same"), (2, None, "same"), (7, "https://a.com/", None), (8, "nourl", ""), (9, "http://c.org", "päge " * 30_000), (9, "http://c.org", "päge " * 30_000), (None, "http://d.org/", "same"), (4, "http://a.com/", "own")]


def test_archives_come_back(spark, tmp_path):
    spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, refers_to string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op1_warc_index(spark, str(tmp_path)).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(p[0]) for p in PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[(h or "")] = min(first.get(h or "", i), i)
    for r in got:
        data = html[r["page_id"]]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r["page_id"] is not None:
            lead = first[data.decode()]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if lead == r["page_id"] else ("revisit", lead))
    keys = [(r["url_key"], r["captured"]) for r in sorted(got, key=lambda r: (r["range_no"], r["position"]))]
    assert keys == sorted(keys)


def test_archives_are_plain_gzip_records(spark, tmp_path):
    import glob
    import gzip

    rows = spark.createDataFrame([(1, "http://a/", b"one", "s"), (2, "http://b/", b"two", "s")], "page_id long, url string, payload binary, x string").selectExpr("*", "timestamp'2024-01-01 00:00:00' AS captured", "sha1(payload) AS sha1", "cast(NULL AS long) AS refers_to")
    archives = warc.write_archives(rows.coalesce(1), f"file://{tmp_path}/w", archive_bytes=1).collect()
    assert [r["records"] for r in archives] == [1, 1]
    text = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{tmp_path}/w/*.warc.gz")))
    assert text.count(b"WARC/1.1\r\n") == 2 and b"one\r\n\r\n" in text and b"WARC-Target-URI: http://a/" in text


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc_index(spark, str(tmp_path)).collect() == []


def brute(rows, every, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_odd_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.5, 0.5]), (40, [-1.0, 0.0])]
    odd = [(60, None), (80, []), (100, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int")
    got = ann.search(df).collect()
    want = brute(rows, 20, 20)
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
    assert ann.search(df.limit(0)).collect() == []


def test_recall_of_learned_partitions(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 24))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.6, (3000, 24))
    x[::3] = x[0]  # a third of all rows is one vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, part_rows=300, sample=1000).toPandas()
    want = brute(rows, 20, 20)
    found = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert np.mean([len(found[q] & set(v)) / 20 for q, v in want.items()]) >= 0.9


def recall(got, want):
    found = {q: set(g["vec_id"]) for q, g in got.groupby("query_id")}
    assert set(found) == set(want) and all(len(found[q]) == len(v) for q, v in want.items())
    return np.mean([len(found[q] & set(v)) / max(len(v), 1) for q, v in want.items()])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_vectors_are_searched_through_parts(spark, monkeypatch, sf):
    parts, learn = [], ann.learn
    monkeypatch.setattr(ann, "learn", lambda x, n: parts.append(learn(x, n)) or parts[-1])
    got = ann.op4_learned_partitions(spark, f"/root/testdata/{sf}").toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    assert parts[0]["parts"] >= ann.LEAST_PARTS
    assert recall(got, brute(rows, 20, 20)) >= 0.9


def test_parts_of_parts(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(0, 1, (300, 16))
    x = centres[rng.integers(0, 300, 50_000)] + rng.normal(0, 0.3, (50_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = ann.search(df, every=500, part_rows=100, sample=4000).toPandas()
    ask = np.arange(0, 50_000, 500)
    scores = x[ask] @ x.T
    scores[np.arange(len(ask)), ask] = -np.inf
    want = {int(q): np.argsort(-s, kind="stable")[:20].tolist() for q, s in zip(ask, scores)}
    assert recall(got, want) >= 0.9


def test_pipeline_keeps_columns_and_decides(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    # words of real texts: a text of a dozen words over and over is what the quality rules reject
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang IN ('en', 'de') AND text IS NOT NULL").toPandas()
    words = {k: sorted({w for t in given[given["lang"] == lang]["text"] for w in t.split() if w.isalpha()}) for k, lang in (("aa", "en"), ("bb", "de"))}
    rows = []
    for i in range(160):
        k = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(rng.choice(words[k], 120)) + f" {i}", k, f"s{i % 2}", 1))
    rows += [(500, rows[0][1], "bb", "s0", 1), (501, None, "aa", "s1", 0), (502, "too short", "aa", "s1", 0), (503, "1 2 3 " * 20, "aa", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert not {500, 501, 502, 503} & set(out["doc_id"]) and set(range(100)) & set(out["doc_id"])
    assert (out.groupby("sequence_id")["length"].sum() <= 4096).all()


def test_empty_table_goes_through_every_stage(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score int, part string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == [] and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "part"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect() == []


def test_equal_entries_are_cut_into_ranges(spark):
    rows = spark.range(4000).selectExpr("'run' AS run", "id AS seq", "cast(NULL AS string) AS url_key", "timestamp'2024-01-01 00:00:00' AS captured", "cast(NULL AS bigint) AS page_id")
    for name in warc.ENTRY.split(", ")[5:]:
        rows = rows.withColumn(name.split()[0], F.lit(None).cast(name.split()[1].replace("long", "bigint")))
    got = warc.merge_runs(rows, parts=4).select("range_no", "position", "seq").collect()
    sizes = [sum(r["range_no"] == k for r in got) for k in range(4)]
    assert sum(sizes) == 4000 and max(sizes) < 2000
    assert [r["seq"] for r in sorted(got, key=lambda r: (r["range_no"], r["position"]))] == list(range(4000))
