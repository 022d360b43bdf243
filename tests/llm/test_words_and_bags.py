"""Spelling variants, fill-in-the-middle, quality by attention and the language classifier: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from attestor.llm import fim, langid, mil, spelling
from attestor.llm.common import bounded_sample, prepare
from pyspark.sql import functions as F

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SF = "/root/testdata/sf0.01"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def near(a: str, b: str) -> bool:
    """Exactly one edit, by the plain definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_trie_emits_all_words_at_distance_one():
    random.seed(3)
    words = sorted({"".join(random.choice("abÀé") for _ in range(random.randint(1, 6))) for _ in range(900)} | {"a" * 3000, "a" * 2999})
    trie = spelling.Trie(words, [1] * len(words))
    for w in [*random.sample(words, 200), "", "zz", "a" * 3001, "a" * 3000]:
        assert trie.near(w) == {i for i, x in enumerate(words) if near(w, x)}
    assert spelling.Trie(["only"], [1]).near("onl") == {0} and spelling.Trie([], []).near("x") == set()


def test_checksums_of_pairs_are_crc32():
    words, prefixes = ["a", "éà", "q" * 200, "hello"], [b"12:", b":", b"-7:"]
    doc, code = np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)
    found = spelling.pair_checksums(prefixes, doc, pa.array(words, pa.large_string()), code)
    assert found.tolist() == [zlib.crc32(prefixes[d] + words[c].encode()) for d, c in zip(doc, code)]


def expected_variants(rows, shortest, least, spoil):
    total = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= shortest and c >= least}
    out = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(close), form, n[form] if form else None)
    for w, v in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] = (*v, root)
    return out


def test_spelling_variants_by_brute_force(spark):
    rng = random.Random(5)
    base = ["colour", "color", "colors", "Überfluß", "night", "nights", "knight", "éclair", "eclair", "tower", "towers", "powers"]
    rows = [(rng.choice([1, 2, 3, None]), " ".join(rng.choices(base, range(12, 0, -1), k=rng.randint(0, 60))) + rng.choice(["", ".", "<P>×÷ ÀÀÀÀÀÀ", " x" * 9])) for _ in range(60)]
    rows += [(4, None), (5, ""), (6, "a" * 500 + " " + "a" * 499)] + [rows[0]] * 7 + [(9, "a" * 500)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    for spoil in (None, 5):
        found = spelling.variants(spelling.vocabulary(df, least=2, spoil=spoil), shard_chars=40, wave_bytes=2000).collect()
        assert {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found} == expected_variants(rows, 5, 2, spoil) and len({r["word"] for r in found}) == len(found)
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_a_hot_word_and_long_paths_of_forms(spark):
    words = [("a" * k, 3 * 2 ** (12 - k)) for k in range(5, 13)]  # each the form of the next longer
    found = {r["word"]: r for r in spelling.variants(spark.createDataFrame(words, "word string, n long"), shard_chars=11).collect()}
    assert all(r["root"] == "aaaaa" for r in found.values()) and found["a" * 12]["form"] == "a" * 11 and found["aaaaa"]["form"] is None
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame(words, "word string, n long"), ratio=1)


TEXTS = [None, "", "x", "plain words. " * 90, "é€😀<" * 700, "a<P>b" * 9, "<<S", "tail <", "\n\n", "line one\nline two\r\nlast", "z" * 9000]


def test_scan_functions_compose_in_any_grouping():
    auto, data = fim.Automaton(), np.frombuffer(("é<P>€😀<" * 50 + "<S").encode(), np.uint8)
    whole = fim.scan(data, np.array([0]), np.array([len(data)]), auto)
    for step in (1, 3, 64):
        _, begin, size = fim.chunks_of(np.array([0, len(data)]), step)
        ends, counts = fim.reduce(*fim.scan(data, begin, size, auto))
        assert ends.tolist() == whole[0][0].tolist() and counts.tolist() == whole[1][0].tolist()
    assert whole[1][0][0] % fim.MARK == 50 * 7 + 2 and whole[1][0][0] // fim.MARK == 50


@pytest.mark.parametrize("unit", ["code_point", "line"])
def test_fill_in_middle_is_exact_near_and_giant(spark, unit):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(TEXTS * 6)] + [(77, TEXTS[4])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("output", F.lit(1))
    one = fim.transform(df, carry=["doc_id", "text", "n", "output"], unit=unit)
    two = fim.transform(df, carry=["doc_id", "text", "n", "output"], unit=unit, giant=100, block=37)
    got = sorted(map(repr, one.collect()))
    assert got == sorted(map(repr, two.collect())) and len(got) == len(rows)
    for r in one.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect():
        t = r["doc"]["text"] or ""
        units = list(t) if unit == "code_point" else re.findall(r"[^\n]*\n|[^\n]+", t)
        h = hashlib.sha256(f"1:{'' if r['doc']['doc_id'] is None else r['doc']['doc_id']}".encode()).hexdigest()
        a, b = sorted(int(h[k : k + 8], 16) % (len(units) + 1) for k in (0, 8))
        form = "plain" if not t or any(m in t for m in fim.CONTROLS) or int(h[16:24], 16) % 100 >= 90 else "spm" if int(h[24:32], 16) % 100 < 20 else "psm"
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        assert r["output"] == {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["back"]) == (len(units), form, t) and (r["prefix_units"], r["middle_units"]) == ((None, None) if form == "plain" else (a, b - a))
    assert fim.transform(df.limit(0), carry=["doc_id"]).count() == 0


def test_attention_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in mil.start(rng).items()}
    x, figures, first, y = rng.random((5, mil.BUCKETS)) * (rng.random((5, mil.BUCKETS)) < 0.01), rng.random((5, mil.FIGURES)), np.array([0, 2, 5]), np.array([1.0, 0.0])
    m["emb"] *= 30
    _, grad = mil.gradients(x, figures, first, y, m)
    for k in m:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), m[k].shape)
        kept, e = m[k][at], 1e-5
        m[k][at] = kept + e
        up, _ = mil.gradients(x, figures, first, y, m)
        m[k][at] = kept - e
        down, _ = mil.gradients(x, figures, first, y, m)
        m[k][at] = kept
        assert abs((up - down) / (2 * e) - grad[k][at]) < 1e-3 * max(1e-3, abs(grad[k][at])), k


def plain_grams(word: str, orders, buckets: int, lower: bool):
    data, out = f"<{word.lower() if lower else word}>".encode(), []
    for k in orders:
        for i in range(len(data) - k + 1):
            h = k
            for b in data[i : i + k]:
                h = (h * 0x100000001B3 % 2**64) ^ b
            out.append((h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - buckets.bit_length() + 1))
    return out


def test_passages_are_scored_as_a_plain_loop_does():
    rng = np.random.default_rng(2)
    m = mil.start(rng) | {"heat": 1.3}
    texts = [None, "", " \n ", "Some words !!! ###", "one two " * 100, "w" * 3000, "x\x1cy é€😀 " * 70]
    for t, s in zip(texts, mil.score_texts(pa.array(texts), m)):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        parts = [words[i : i + mil.PASSAGE] for i in range(0, len(words), mil.PASSAGE)] or [[]]
        hs, scores = [], []
        for p in parts:
            g = [b for w in p for b in plain_grams(w, mil.ORDERS, mil.BUCKETS, False)]
            mean = m["emb"][g].mean(0) if g else np.zeros(mil.HIDDEN)
            full = max(len(p), 1)
            figures = np.array([len(set(p)) / full, sum(map(len, p)) / full / 10, np.log1p(len(p)) / 5, np.log1p(len(parts)) / 5])
            h = np.tanh(mean + figures @ m["fig"] + m["b1"])
            hs.append(h)
            scores.append((np.tanh(h @ m["v"]) * mil.sigmoid(h @ m["u"])) @ m["w"])
        a = np.exp(scores) / np.exp(scores).sum()
        assert abs(mil.sigmoid(((a @ np.array(hs)) @ m["c"] + m["b0"][0]) / 1.3) - s) < 1e-4


def test_quality_on_held_out_labels_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (None, ""), (5, " "), (5, "word " * 30_000)], "doc_id long, text string")
    model = mil.learn(docs.select("doc_id", "text").unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"), allowMissingColumns=True))
    held = docs.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = mil.score(held, model, carry=["doc_id", "quality"]).collect()
    right = [(r["score"] >= 0.5) == (r["doc"]["quality"] == 1) for r in got]
    assert len(right) > 100 and np.mean(right) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in mil.score(odd.withColumn("score", F.lit("x")), model, carry=["doc_id", "score"]).collect())
    none = mil.learn(docs, labels.limit(0))
    assert {r["score"] for r in mil.score(odd, none, carry=["doc_id"]).collect()} == {0.5} and mil.score(odd.limit(0), none, carry=["doc_id"]).count() == 0
    same = mil.learn(docs, labels.filter("quality = 1"))
    assert all(r["score"] > 0.9 for r in mil.score(odd, same, carry=["doc_id"]).collect())


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = spark.range(3000).selectExpr("cast(NULL AS bigint) AS id", "concat('text ', id) AS text", "IF(id % 3 = 0, 'a', 'b') AS lang").unionByName(spark.range(400).selectExpr("1L AS id", "'same' AS text", "'c' AS lang"))
    take = lambda **k: Counter(r["lang"] for r in bounded_sample(rows, of=F.col("lang"), key=F.xxhash64("id", "text"), **k).collect())
    assert take(rows_=50, size=1 << 20) == {"a": 50, "b": 50, "c": 50}  # rows without an id are drawn one by one, equal rows are cut by rank
    assert take(rows_=5000, size=400)["c"] == 100 and take(rows_=50, size=1 << 20, classes=1) == {"b": 50}


def test_languages_are_told_apart_on_few_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for d, model in ((docs, langid.learn(docs)), (docs, langid.learn(docs.withColumn("doc_id", F.lit(None).cast("long")), per_lang=80))):
        rows = langid.identify(d.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2), model, carry=["lang"]).collect()
        for lang in ("de", "en", "es", "fr"):
            own = [r["lang_pred"] == lang for r in rows if r["doc"]["lang"] == lang]
            assert len(own) > 10 and np.mean(own) >= 0.98, lang


def test_predictions_are_those_of_a_plain_loop():
    model = langid.fit(["the cat sat", "le chat dort", "der hund bellt"] * 4, ["en", "fr", "de"] * 4, [False] * 12)
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].slice(0, 12).to_pylist() + [None, "", "123", "q" * 4000, "a b " * 400]
    best, score = langid.predict_texts(pa.array(texts), model)
    for t, i, s in zip(texts, best, score):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if not any(c.isalpha() for w in words for c in w):
            assert (i, s) == (-1, 0)
            continue
        mean = np.mean([model["emb"][b] for w in words for b in plain_grams(w, langid.ORDERS, langid.BUCKETS, True)], axis=0)
        z = (mean @ model["w"] + model["b"]) / model["heat"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert i == p.argmax() and abs(p.max() - s) < 1e-3
