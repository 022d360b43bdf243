"""Packing, SimHash, language ID, fertility and the language model: against brute force, round trips and held-out figures."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from attestor.llm import fertility, langid, packing, rnnlm, simhash
from attestor.llm.common import prepare, split_words
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "Two words", "a b c d e", "ÀÉ \x1c x\x85y z", "<|endoftext|> <|EndOfText|>x don't İstanbul ΣΑΣ 漢字 e\u0301 ¼ x²", "z" * 50_000, "long text, whole. " * 6000]


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def docs_of(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_split_words():
    codes, offsets, words = split_words(pa.array(ODD), lower=False)
    listed = words.to_pylist()
    for t, a, b in zip(ODD, offsets[:-1], offsets[1:]):
        assert [listed[c] for c in codes[a:b]] == WORDS.findall(t or "")


def test_token_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    for t, ids in zip(ODD, packing.token_ids(pa.array(ODD), packing.vocabulary_path())):
        assert ids.tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing_is_tight_and_whole(spark):
    rng = np.random.default_rng(1)
    texts = ODD + ["w " * int(n) for n in rng.integers(1, 9000, 200)] + ["same"] * 3
    parts = packing.pieces(docs_of(spark, texts), with_ids=True)
    got = packing.pack(parts.cache()).toPandas()
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1].tolist()] and seq["length"].sum() <= 4096
    for _, doc in got.groupby("doc_id"):
        doc = doc.sort_values("piece")
        assert doc["start"].tolist() == [0, *np.cumsum(doc["length"])[:-1].tolist()]
        assert all(n == 4096 for n in doc["length"][:-1])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    assert got["sequence_id"].nunique() <= 1.03 * -(-got["length"].sum() // 4096) + 1
    assert packing.packed(docs_of(spark, texts).limit(0)).collect() == []


def test_sum_of_squares_places_by_least_sum():
    lengths, capacity = np.array([5, 3, 3, 7, 2, 2, 4, 1, 6, 10]), 10
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths, bins, offsets):
        gap = gaps.get(int(b), capacity)
        assert o == capacity - gap

        def squares(changed):
            counts = np.bincount([g for g in changed if g], minlength=capacity + 1)
            return int((counts[1:] ** 2).sum())

        ways = [squares([*[g for k, g in gaps.items() if k != c], gaps[c] - s]) for c in gaps if gaps[c] >= s] + [squares([*gaps.values(), capacity - s])]
        gaps[int(b)] = gap - int(s)
        assert squares(gaps.values()) == min(ways)


def plain_fingerprint(text):
    import xxhash

    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs_of(spark, ODD)).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(ODD)}


def brute_components(fps, most=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = list(base)
    for f in base[:30]:  # chains of near copies, and one dense group of more than a small cell
        for _ in range(4):
            f ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.append(f)
    fps += [base[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2)) if a != b] + [base[1]] * 5
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame([(f,) for f in {f for _, f in rows}], "fp long")
    nodes = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct), f"file:///tmp/attestor-test-{rng.integers(1 << 60)}").collect()}
    roots = [nodes.get(f, f) for _, f in rows]
    want = brute_components(fps)
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want))


def test_links_at_any_distance_and_any_number_of_groups(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = sorted({f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for f in base for n in range(7)})
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for most, groups in ((4, 9), (6, None), (1, 4)):
        nodes = {r["node"]: r["root"] for r in simhash.components(simhash.links(distinct, most, groups), f"file:///tmp/attestor-test-{rng.integers(1 << 60)}").collect()}
        roots = [nodes.get(f - (1 << 64) if f >> 63 else f, f) for f in fps]
        want = brute_components(fps, most)
        assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want)), most
    with pytest.raises(ValueError):
        simhash.links(distinct, most=4, groups=5)
    assert [tuple(r) for r in simhash.links(distinct.filter("fp is null"), most=4).collect()] == []
    assert [simhash.groups_for(1 << k) for k in (0, 18, 22, 30)] == [6, 6, 7, 10]


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (3, text + " more", "b"), (9, text, "c"), (9, text, "c"), (None, text, "n"), (None, None, "n"), (4, "quite another text, about other things", "d"), (None, "alone without any id but with words", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["3", "4", "None", "None"]
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_one_of_each_keeps_both_texts_of_a_reused_id(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(300)) for k in "ab")
    docs = spark.createDataFrame([(7, one, "a"), (7, two, "b"), (7, two, "b"), (8, one, "c"), (9, None, "d")], "doc_id long, text string, fp string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["fp"]) for r in kept.collect()) == [(7, "a"), (7, "b"), (9, "d")]


LANGS = {"aa": "zon mir tal vek dor", "bb": "lui sae pei noa rui", "cc": "grrk hjjl zzpt krrn"}


def corpus(n=240):
    rng = np.random.default_rng(3)
    return [(i, " ".join(rng.choice(LANGS[k].split(), 30)), k) for i, k in zip(range(n), list(LANGS) * n)]


def test_language_id_held_out(spark, tmp_path):
    rows = corpus() + [(1000, None, "aa"), (1001, "12 34 --", "bb"), (1002, "zon tal", None), (None, "sae pei", "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows if i is not None)
    held = [(i, k) for i, _, k in corpus() if got[i]["held_out"]]
    assert len(held) > 30 and all(got[i]["lang_pred"] == k and not got[i]["rejected"] for i, k in held)
    assert [got[i]["lang_pred"] for i in (1000, 1001)] == ["und", "und"] and got[1000]["score"] == 0 and got[1000]["rejected"]
    assert got[1002]["lang_pred"] == "aa" and 0 <= got[1002]["score"] <= 1


def test_language_id_without_labels_and_with_clashes(spark):
    docs = spark.createDataFrame([(1, "some text", None, 9)], "doc_id long, text string, lang string, score int")
    model = langid.learn(docs)
    got = langid.identify(docs, model, carry=docs.columns).collect()
    assert got[0]["lang_pred"] == "und" and got[0]["doc"]["score"] == 9
    assert langid.identify(docs.limit(0), model, carry=["doc_id"]).collect() == []


def plain_repeats(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return len(covered)


def test_quality_counts(spark):
    rng = np.random.default_rng(4)
    texts = [*ODD[:8], "a b c d e f a b c d e g", "x x x x x x x", "l1 #\n\nl1 #\nl2 $|\n \nl1 #"] + [" ".join(rng.choice(list("abc"), 60)) for _ in range(20)]
    rows = [(i, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = {r["doc"]["doc_id"]: r for r in fertility.judge(docs, carry=docs.columns).collect()}
    for i, t in enumerate(texts):
        words = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), plain_repeats(t))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert fertility.judge(docs.limit(0), carry=["doc_id"]).collect() == []


def test_fertility_rejects_noise_and_keeps_prose():
    prose = "The committee will meet again on Thursday to discuss what the report says about the new bridge and the road beside it. " * 2
    german = "Der Ausschuss trifft sich am Donnerstag erneut, um zu besprechen, was der Bericht über die neue Brücke und die Straße sagt. " * 2
    noise = " ".join("".join(chr(0x2500 + (i * 7 + j * 3) % 200) for j in range(6)) for i in range(80))
    m = fertility.measure(pa.array([prose, german, noise]), fertility.vocabulary_path())
    assert fertility.in_band(m, ["en", "de", "en"]).tolist() == [True, True, False]
    p = np.bincount([t for w in prose.split() for t in fertility._pieces(fertility.vocabulary_path())[0].encode(w)])
    p = p[p > 0] / p.sum()
    assert m["entropy"][0] == pytest.approx(-(p * np.log2(p)).sum())


def test_entropy_is_held_to_what_the_length_leads_to_expect():
    words = "the of and to in is that for it was on are with they be at one have this from by word but what some we can out other were all your when up use how said an each she".split()
    text = " ".join(np.random.default_rng(8).choice(words, 1500))
    m = fertility.measure(pa.array([text]), fertility.vocabulary_path())
    assert m["entropy"][0] > 5 and fertility.in_band(m, ["en"]).tolist() == [False]
    same = {"n_tokens": np.array([10, 64, 4096]), "entropy": np.array([3.0, 5.5, 5.5]), "chars_per_token": np.full(3, 4.0), "byte_share": np.zeros(3), "script": np.zeros(3, int)}
    for lang in ("en", "de", "fr", "es", None):
        assert fertility.in_band(same, [lang] * 3).tolist() == [True, True, False]


def test_gradients_point_downhill():
    rng = np.random.default_rng(5)
    docs = [np.tile(rng.integers(0, 40, 12), 20).astype(np.int32) for _ in range(40)]
    p = rnnlm.start(np.bincount(np.concatenate(docs), minlength=rnnlm.SYMBOLS).astype(float))
    before = rnnlm.score(p, docs, 0).sum()
    for _ in range(6):
        p = rnnlm.train(p, docs, 0)
    assert rnnlm.score(p, docs, 0).sum() > before * 0.8  # log probabilities are negative


def test_slopes_of_a_step_are_its_derivatives():
    rng = np.random.default_rng(12)
    n = rnnlm.HIDDEN
    p = {k: v.astype(float) for k, v in rnnlm.start(np.ones(rnnlm.SYMBOLS)).items()}
    h, x, slopes = rng.normal(0, 0.4, (3, n)), np.array([5, 9, 5]), np.empty((3, 3, n))
    new, gate = rnnlm.step(p, h, x, slopes)
    assert new == pytest.approx(rnnlm.step(p, h, x)[0])
    for k in range(2):  # the inputs of the candidate and of the gate
        moved = {**p, "x": p["x"].copy()}
        moved["x"][k] += 1e-6
        assert (rnnlm.step(moved, h, x)[0] - new) / 1e-6 == pytest.approx(slopes[k], rel=1e-3, abs=1e-5)
    e = np.eye(n)[3] * 1e-6  # by a component of the state before, through both products and past them
    want = slopes[1] * p["u"][0][3] + slopes[2] * p["u"][1][3] + (1 - gate) * np.eye(n)[3]
    assert (rnnlm.step(p, h + e, x)[0] - new) / 1e-6 == pytest.approx(want, rel=1e-3, abs=1e-5)


def test_rows_of_a_symbol_are_summed_whole():
    rng = np.random.default_rng(13)
    for sym in (np.minimum(rng.zipf(1.2, 5000), 900), np.full(3000, 7), np.arange(40), np.repeat(np.arange(3), rnnlm.RUN)):
        rows, counts = rng.normal(0, 1, (2, len(sym), 5)), np.bincount(sym)
        want = np.zeros((2, len(counts), 5))
        for k in range(2):
            np.add.at(want[k], sym, rows[k])
        counts = counts[counts > 0]
        got = rnnlm.sums_of_runs(rows, np.argsort(sym, kind="stable"), np.cumsum(counts) - counts, counts)
        assert got == pytest.approx(want[:, np.unique(sym)])


def test_spellings_are_of_distinct_words_and_not_of_each_chunk(spark):
    words = ["the", "The", "naïve", "9.", "a,", "x"]
    coded = rnnlm.encode(docs_of(spark, [" ".join(words)] * 3).repartition(3))
    assert "spelling" not in coded.columns
    counted = coded.filter("kind = 1").groupBy("token").agg(F.sum("times").alias("c"))
    want = {w: rnnlm.spelling(w) for w in (x.lower() for x in words)} | {rnnlm.END: 0}
    assert {r["token"]: r["spelling"] for r in rnnlm.spelt(counted).collect()} == want


def test_state_is_carried_and_reset():
    rng = np.random.default_rng(6)
    p = {k: v + rng.normal(0, 0.1, v.shape).astype(np.float32) for k, v in rnnlm.start(np.ones(rnnlm.SYMBOLS)).items()}
    docs = [rng.integers(0, rnnlm.SYMBOLS, n).astype(np.int32) for n in (1, 300, 5, 77)]

    def alone(d):
        h, total, x = np.zeros((1, rnnlm.HIDDEN), np.float32), 0.0, 3
        for y in d:
            h, _ = rnnlm.step(p, h, np.array([x]))
            total += rnnlm.log_probs(p, h, np.array([y]))[0]
            x = y
        return total

    assert rnnlm.score(p, docs, 3) == pytest.approx([alone(d) for d in docs], rel=1e-4)
    every = rnnlm.log_probs(p, np.repeat(rng.normal(0, 1, (1, rnnlm.HIDDEN)).astype(np.float32), rnnlm.SYMBOLS, 0), np.arange(rnnlm.SYMBOLS))
    assert np.exp(every).sum() == pytest.approx(1, rel=1e-4)


def test_language_model_beats_its_base_on_held_out_text(spark, tmp_path):
    rng = np.random.default_rng(7)
    a, b = "red green blue grey pink".split(), "one two three four five".split()
    texts = [" ".join(rng.choice(a if i % 2 else b, 60)) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, "neverseen word"), (1003, texts[0]), (1003, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = rnnlm.op7_recurrent_lm(spark, str(tmp_path)).toPandas()
    train = [WORDS.findall((t or "").lower()) + ["\n"] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    count: dict[str, int] = {}
    for w in (w for d in train for w in d):
        count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = {i: sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in WORDS.findall((t or "").lower()) + ["\n"]) for i, t in rows}
    assert len(got) == len(rows) and set(got["train_tokens"]) == {n}
    assert all(r.base_score == pytest.approx(want[r.doc_id]) for r in got.itertuples())
    held = got[got["held_out"] & (got["doc_id"] < 1000)]
    assert len(held) > 15 and held["score"].sum() > held["base_score"].sum()
    assert rnnlm.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_network_is_fitted_on_every_training_document(spark, tmp_path, monkeypatch):
    rows = [(i, f"word{i} and more words") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, fit = [], rnnlm.fit

    def watched(symbols, p, end, tokens, **how):
        seen.append((symbols.count(), tokens))
        return fit(symbols, p, end, tokens, **how)

    monkeypatch.setattr(rnnlm, "fit", watched)
    rnnlm.op7_recurrent_lm(spark, str(tmp_path)).collect()
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert seen == [(len(train), sum(len(t.split()) + 1 for t in train))]


def test_whole_document_score_is_a_plain_loop_and_does_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(1500)]  # more than the network tells apart
    texts = [" ".join(words[int(k)] for k in rng.zipf(1.3, int(rng.integers(1, 80))) % 1500) for _ in range(250)] + ["", "w1 " * 4000, "Unseen-word, w1 w2"]
    docs = docs_of(spark, texts)
    kept, fit = [], rnnlm.fit

    def watched(symbols, p, end, tokens, **how):
        kept.append((fit(symbols, p, end, tokens, **how), end))
        return kept[-1][0]

    monkeypatch.setattr(rnnlm, "fit", watched)
    one = {r["doc_id"]: r["score"] for r in rnnlm.score_documents(docs.coalesce(1), replica_tokens=4000).collect()}
    four = {r["doc_id"]: r["score"] for r in rnnlm.score_documents(docs.repartition(4), replica_tokens=4000).collect()}
    assert four == pytest.approx(one, rel=1e-3)

    count: dict[str, int] = {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            for w in [*WORDS.findall(t.lower()), "\n"]:
                count[w] = count.get(w, 0) + 1
    top = sorted([(w, c) for w, c in count.items() if w != "\n"], key=lambda r: (-r[1], r[0]))[: rnnlm.HEAD - 1]
    head = {w: i for i, (w, _) in enumerate(sorted([*top, ("\n", count["\n"])], key=lambda r: (-r[1], r[0])))}
    rest = [(rnnlm.spelling(w), c) for w, c in count.items() if w not in head]
    p, end = kept[0]
    assert end == head["\n"]
    for i in (0, 7, 250, 252):
        h, x, total = np.zeros((1, rnnlm.HIDDEN), np.float32), end, 0.0
        for w in [*WORDS.findall(texts[i].lower()), "\n"]:
            h, _ = rnnlm.step(p, h, np.array([x]))
            if w in head:
                x = head[w]
            else:
                of = [c for s, c in rest if s == rnnlm.spelling(w)]
                x = rnnlm.HEAD + rnnlm.spelling(w)
                total += np.log10((count.get(w, 0) + 0.1) / (sum(of) + 0.1 * (len(of) + 1)))
            total += rnnlm.log_probs(p, h, np.array([x]))[0] / np.log(10)
        assert one[i] == pytest.approx(total, rel=1e-4)


def test_repeated_rows_are_dealt_to_all_shards(spark, tmp_path):
    spark.range(100_000).selectExpr("7L doc_id", "0 piece", "0L start", "int(3 + id % 2) * 1000L length", "5L ids_crc32").write.parquet(f"{tmp_path}/parts")
    got = packing.pack(spark.read.parquet(f"{tmp_path}/parts"), shard=20_000).toPandas()
    got["shard"] = got["sequence_id"] // (1 << 32)
    assert len(got) == 100_000 and got["shard"].nunique() == 5 and got.groupby("shard").size().max() < 22_000


def test_words_of_any_kind_get_the_tokenizers_ids():
    import random

    path = packing.vocabulary_path()
    whole, rng = packing.tokenizer(path).whole, random.Random(1)
    letters = "abzZ019'sStTdD.!?<|>éÉßİıǅ\u0308\u00ad\u200d日本🙂ÆɐɏÅﬁ\x01\x7f  \n\t"
    texts = ["<|endoftext|> a<|b", "", None] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    for text, ids in zip(texts, packing.token_ids(pa.array(texts, pa.string()), path)):
        assert ids.tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_repeated_rows_are_dealt_out(spark, tmp_path):
    rows = spark.createDataFrame([(5, b"ab")] * 9000 + [(6, b"ab")] * 2 + [(7, b"c"), (8, b"")], "h long, ids binary")
    got = rnnlm.dealt(rows, str(tmp_path)).toPandas()
    assert got.h.nunique() == len(got) == 9004 and {7, 8} <= set(got.h)
    assert sorted(map(bytes, got.ids)) == [b""] + [b"ab"] * 9002 + [b"c"]
    groups = np.bincount(got.h % 48, minlength=48)  # as fit deals rows to groups
    assert groups.min() > 100 and groups.max() < 300
    assert sorted(got.h) == sorted(rnnlm.dealt(rows.repartition(3), str(tmp_path)).toPandas().h)
    assert rnnlm.dealt(rows.limit(0), str(tmp_path)).count() == 0


def test_weights_are_summed_in_a_tree(spark):
    tables = [np.array([k, 1, -k], "<f4") for k in range(600)]
    own = spark.createDataFrame([(k, k + 1, t.tobytes()) for k, t in enumerate(tables) if k % 7], "g int, size long, weights binary")
    got = rnnlm.summed(own, 600).collect()
    assert len(got) == 3 <= rnnlm.FAN_IN
    assert sum(np.frombuffer(bytes(r["weights"]), "<f4") for r in got).tolist() == sum(t for k, t in enumerate(tables) if k % 7).tolist()
    assert sum(r["size"] for r in got) == sum(k + 1 for k in range(600) if k % 7)
