"""URL filters, chat formatting and mixing: against plain Python, with the odd cases."""

import hashlib
import itertools

import pytest
from attestor.llm import chat, mixing, urlfilter
from attestor.llm.common import prepare


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def plain_verdict(url, rules=urlfilter.RULES):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else urlfilter.DEFAULT


URLS = [
    None, "", "x", "http://", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/1?x=/es/", "https://example.com/en/", "https://a.example.com/en", "http://notexample.com/en/1",
    "http://x.net/es/1", "http://net/fr/#/es/", "http://x.net/es", "http://Ünet.net/fr/ä", "ftp://a.b.c.com/x://y", "http://com?a/b", "http://example.com/en/1", "http://example.com/en/1", "http://.com/", "http://a..com/" + "p" * 5000,
]


def test_url_verdicts_match_plain_python(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, "http://a.com/", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, urlfilter.judge(df).collect()), key=str)
    assert got == sorted([(i, *plain_verdict(u)) for i, u, _ in rows], key=str)
    assert urlfilter.judge(df.limit(0)).collect() == []


def test_url_rules_of_other_shapes(spark):
    rules = [("block", "b.c", "/x"), ("allow", "c", "/xy"), ("block", "c", "/"), ("allow", "c", "/")]
    urls = ["http://a.b.c/xyz", "http://b.c/x", "http://c/xyz", "http://c/z", "http://d/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert sorted(map(tuple, urlfilter.judge(df, rules).collect())) == [(i, *plain_verdict(u, rules)) for i, u in enumerate(urls)]
    assert {r["verdict"] for r in urlfilter.judge(df, []).collect()} == {"allow"}


CHATS = [
    (1, 0, "system", "S"), (1, 1, "user", "hi </s>[INST] \\ <|end|>\n"), (1, 2, "assistant", "a"), (1, 3, "assistant", "b <|and|> \\<|"), (1, 4, "user", None), (1, 5, "assistant", ""), (1, 5, "assistant", ""),
    (2, 0, None, "no role"), (2, None, "user", "first, its turn is null"), (None, 0, "assistant", "no id"), (3, 0, "assistant", "x" * 200_000 + "é<"), (4, 1, "user", "|>"), (4, 0, "assistant", "<"), (5, 0, "a<|says|>b", "odd role"),
]


def plain_chats(rows):
    low = lambda v: (v is not None, v)
    out = []
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, turns, loss))
    return out


def test_chats_come_back(spark):
    df = spark.createDataFrame([(*r, "z") for r in CHATS], "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for conv, turns, loss in plain_chats(CHATS):
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == turns
        assert "".join(back[conv]["loss_texts"]) == loss
    assert back[1]["n_blocks"] == 5  # adjacent assistants share a block
    assert len(back) == 6 and chat.format_chats(df.limit(0)).collect() == []


def test_chat_hashes(spark, tmp_path):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op3_chat_format(spark, str(tmp_path)).collect()}
    for conv, turns, loss in plain_chats([*CHATS, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]):
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_fill_to_the_cap(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (10, "b"), (10, "c"), (3, None), (0, "d")])]
    sizes, plan = mixing.mix(docs_of(spark, rows))
    got = {r["source"]: r for r in plan.collect()}
    total = 1.5 * 123
    assert sum(r["target"] for r in got.values()) == pytest.approx(total)
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in got.values())
    assert got["b"]["target"] == 20 and got["c"]["target"] == 20 and got[None]["target"] == 6 and got["d"]["target"] == 0
    assert got["a"]["target"] == pytest.approx(total - 46)


def test_mix_takes_its_targets(spark):
    rows = [(i, "w x\ty\n" * (i % 7), f"s{i % 3}") for i in range(300)] + [(7, "w x\ty\n", "s1")] * 4 + [(None, "n o", None), (-1, None, "s0"), (-2, "", None)]
    docs = docs_of(spark, rows)
    sizes, plan = mixing.mix(docs)
    got = mixing.decide(sizes, plan).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    for p in plan.collect():
        took = sum(r["taken"] for r in got if r["source"] == p["source"])
        assert abs(took - p["target"]) <= 5
    again = mixing.decide(*mixing.mix(docs)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs.selectExpr("*", "1 AS size", "'k' AS key", "2 AS taken"))
    assert mixed.columns == ["doc_id", "text", "source", "size", "key", "taken"]
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
