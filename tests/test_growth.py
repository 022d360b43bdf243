"""What grows by batches: the full-text index, the store of claims and relations; and mentions from a trie."""

import re

import pytest
from attestor.functions.workers import prepare
from attestor.operators import bm25, fulltext, mentions, relate
from attestor.plans import mini_corpus, testbed
from attestor.streaming import ingest, maintained
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_index_answers_as_a_full_scan_at_every_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "?!"), (10**6 + 3, "the the the of")], "doc_id long, text string")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(-1, "the of"), (-2, None), (-3, "qqqqzz"), (-4, "the the")], "item_id long, text string"))
    path, seen = f"file://{tmp_path}/index", None
    assert fulltext.top_k(spark, path, queries, "item_id", "doc_id").count() == 0
    batches = [docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1"), odd, docs.filter("doc_id % 3 = 2"), odd.limit(0)]
    for k, batch in enumerate(batches):
        assert fulltext.append(spark, path, batch, "doc_id", f"b{k}") == k + 1
        seen = batch if seen is None else seen.unionByName(batch)
        if k in (0, 4):
            assert rows(fulltext.top_k(spark, path, queries, "item_id", "doc_id", k=5)) == rows(bm25.top_k(queries, "item_id", seen, "doc_id", k=5))
    assert fulltext.append(spark, path, batches[0], "doc_id", "b0") == 5  # a batch that comes again changes nothing
    assert rows(fulltext.top_k(spark, path, queries, "item_id", "doc_id", k=5, version=1)) == rows(bm25.top_k(queries, "item_id", batches[0], "doc_id", k=5))


def test_windows_that_cannot_hold_a_result_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "WINDOW", 8)
    monkeypatch.setattr(fulltext, "PROBE", 2)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('word ', repeat('fill ', 1 + cast(id % 50 AS INT)), IF(id % 400 = 7, 'rare', ''), ' w', id % 11) AS text")
    queries = spark.createDataFrame([(1, "rare word"), (2, "word w3")], "item_id long, text string")
    path = f"file://{tmp_path}/index"
    fulltext.append(spark, path, docs, "doc_id", "all")
    kept = {r["kept"]: r["count"] for r in fulltext.candidates(spark, path, queries, "item_id", k=3)["windows"].groupBy("kept").count().collect()}
    assert kept[False] > kept[True]
    assert rows(fulltext.top_k(spark, path, queries, "item_id", "doc_id", k=3)) == rows(bm25.top_k(queries, "item_id", docs, "doc_id", k=3))


def test_kept_relations_equal_a_rebuild(spark, tmp_path):
    c = testbed.claims(spark, SF).filter("doc_no < 25").cache()
    parts = [c.filter(F.col("doc_no") % 5 == k) for k in range(5)]
    path = f"file://{tmp_path}/store"
    for k, part in enumerate(parts[:3]):
        assert maintained.put(spark, path, part, f"b{k}") == k + 1
    so_far = c.filter("doc_no % 5 < 3")
    assert rows(maintained.relations(spark, path)) == rows(relate.relations(so_far))
    assert maintained.put(spark, path, parts[1].withColumn("vkey", F.lit("other")), "b1") == 3  # known by name
    # claims change, and some are taken back, while new ones come
    changed = parts[1].withColumn("vkey", F.lit("q:1:bar")).unionByName(parts[3])
    gone = parts[0].filter("l_orderkey % 2 = 0")
    maintained.put(spark, path, changed, "b3", gone=gone)
    now = parts[0].join(gone.select("claim_id"), "claim_id", "left_anti").unionByName(parts[2]).unionByName(changed)
    assert rows(maintained.relations(spark, path)) == rows(relate.relations(now))
    assert rows(maintained.claims(spark, path)) == rows(now)
    assert rows(maintained.relations(spark, path, version=3)) == rows(relate.relations(so_far))
    # what was taken back may come again
    maintained.put(spark, path, parts[4].unionByName(gone).unionByName(gone), "b4")
    assert rows(maintained.relations(spark, path)) == rows(relate.relations(now.unionByName(parts[4]).unionByName(gone)))
    c.unpersist()


def test_a_version_has_one_writer(spark, tmp_path):
    from attestor.sources.versions import Versions

    one = Versions(spark, f"file://{tmp_path}/v")
    assert one.commit("a", one.folder(), 0) == 1 and one.latest() == 1
    with pytest.raises(RuntimeError):
        one.commit("b", one.folder(), 0)
    assert [b["name"] for b in one.batches()] == ["a"] and one.batches(0) == []


def test_streamed_store_is_related_and_asked(spark, tmp_path):
    register = {re.sub("[^A-Z0-9]", "", s.upper()): e for e, s in mini_corpus.REGISTER}
    el, store = mini_corpus.elements(spark), f"file://{tmp_path}/store"
    for k, part in enumerate(("doc_ord < 2", "doc_ord >= 2")):
        el.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.start(spark.readStream.schema(el.schema).parquet(f"{tmp_path}/in"), register, store, f"{tmp_path}/check").awaitTermination(300)
        assert len(maintained._held(spark, store, None)) == k + 1
    kept = ingest.claims(spark, store)
    assert rows(maintained.relations(spark, store)) == rows(relate.relations(kept))
    answers = mini_corpus.ask(spark, kept, ["What is the current normal operating pressure of the HPU?"])["answers"].collect()
    assert answers[0]["status"] == "ANSWERED_SCOPED" and "200 bar" in answers[0]["sentences"][0]


def test_trie_mentions_by_brute_force(spark):
    names = [("c:1", "PS-04"), ("c:2", "PS-04A"), ("c:3", "Main Pump"), ("c:3", "main pump (left)"), ("c:4", "pump left of tank"), ("c:5", "left"), ("c:6", "Left"), ("c:7", "of the"), ("c:8", "the main"), ("c:9", "unit"), ("c:9", "-"), ("c:10", "one two three four five")]
    texts = ["PS-04 and ps-04a, PS 04, PS-04AB; XPS-04", "The main pump left of tank; main pump (left) of the main pump", None, "", "unit LEFT.left,left", "one two three four five one two  three", "of the of the of the main", "ü" * 5 + "left" + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("surface", F.lit("clash"))
    known = {}
    for e, s in names:
        s = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", s.lower())
        if s and s != "unit":
            known.setdefault(s, set()).add(e)
    expected = set()
    for i, t in enumerate(texts):
        t, hits = (t or "").lower(), []
        for s in known:
            for m in re.finditer(f"(?=(?<![a-z0-9]){re.escape(s)}(?![a-z0-9]))", t):
                hits.append((len(re.findall("[a-z0-9]+", t[: m.start()])), len(re.findall("[a-z0-9]+", s)), s))
        end = 0
        for place, n, s in sorted(hits, key=lambda h: (h[0], -h[1])):
            kept = place >= end
            end = place + n if kept else end
            expected.add((i, place, n, s, min(known[s]) if len(known[s]) == 1 else None, len(known[s]), kept))
    trie = mentions.token_trie(spark.createDataFrame([(e, s, "register") for e, s in names], "entity_id string, surface string, status string"))
    found = mentions.find_all(docs, "doc_id", trie).collect()
    assert {(r["doc_id"], r["place"], r["n_words"], r["surface"], r["entity_id"], r["n_entities"], r["kept"]) for r in found} == expected and len(found) == len(expected)
    assert mentions.find_all(docs, "doc_id", trie.limit(0)).count() == 0
