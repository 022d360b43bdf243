"""Spelling variants: each word's distance-one automaton is met with compact trie shards, depth first.

1. Tasks count the words of whole texts on Arrow arrays; Spark adds the counts up by word (partial sums before the exchange).
2. The vocabulary is range-partitioned in code-point order. Each task packs its range into tries of at most SHARD_CHARS code
   points. A trie is compact: a branch with one word left is a leaf that keeps the rest of the word as it is.
3. Shards are broadcast in waves of at most WAVE_BYTES, so what executors hold does not grow with the vocabulary; only the
   number of waves does. For each word a task walks every shard of the wave depth first with the word's Levenshtein automaton
   of one error: the error-free state follows one path, and each branch off it spends the error and must match exactly.
4. A task reduces what a word meets in its wave to one row (number of near words, best form); Spark reduces the waves.
5. Roots are found by pointer jumping: counts double along forms, so paths are short and hold no cycle.

Defined results: null and empty texts have no words; a null id counts as the empty text where words are spoilt; rows that
repeat count each time; ties of the best form go to the smallest word in code-point order; an empty table gives no words;
other columns of the input are not read.
"""

import pickle
import zlib
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import array_of, batches_by_bytes, id_text, release, split_words, table, work_dir, written

#: Words of so many code points or more, and of so many occurrences or more, are compared.
SHORTEST, LEAST = 5, 3
#: A near word is a word's form if it occurs so many times as often.
RATIO = 2
#: Code points of a shard's words (a longer word is a shard of its own), and pickled bytes of the shards broadcast at a time.
SHARD_CHARS, WAVE_BYTES = 1 << 19, 32 << 20
#: Bytes of texts counted at a time, and words of a search task.
CHUNK, TASK_WORDS = 8 << 20, 20_000
#: Bytes up to which the checksums of words are made for all words at once.
MOST_BYTES = 64


def _crc_table() -> np.ndarray:
    """Table of the reflected CRC-32 polynomial, a byte at a time."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1)).astype(np.uint32)
    return t


CRC = _crc_table()
FULL = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int = 0) -> np.ndarray:
    return (state >> np.uint32(8)) ^ CRC[(state ^ np.uint32(byte)) & np.uint32(255)]


def pair_checksums(prefixes: list[bytes], doc: np.ndarray, words: pa.Array, code: np.ndarray) -> np.ndarray:
    """crc32(prefix of doc[i] + word of code[i]) for all i. The checksum is linear, so the two parts are made apart and added."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data, size = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(offsets)
    tail = np.zeros(len(words), np.uint32)
    for j in range(min(int(size.max(initial=0)), MOST_BYTES)):
        on = np.flatnonzero(size > j)
        tail[on] = _step(tail[on], data[offsets[on] + j])
    head = [np.array([zlib.crc32(p) for p in prefixes], np.uint32) ^ FULL]
    for _ in range(min(int(size.max(initial=0)), MOST_BYTES)):
        head.append(_step(head[-1]))
    out = np.zeros(len(code), np.uint32)
    length = size[code]
    short = length <= MOST_BYTES
    at = np.flatnonzero(short)
    out[at] = np.stack(head)[length[at], doc[at]] ^ tail[code[at]] ^ FULL
    for i in np.flatnonzero(~short):
        out[i] = zlib.crc32(words[int(code[i])].as_py().encode(), zlib.crc32(prefixes[doc[i]]))
    return out


def letters_only(texts: pa.Array) -> pa.Array:
    """Whole texts with A-Z in lower case and spaces in place of all but [a-z\\u00C0-\\u00FF]."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    lead = data == 0xC3  # in UTF-8 the first byte of U+00C0 to U+00FF
    keep = ((data >= 97) & (data <= 122)) | lead
    keep[1:] |= lead[:-1]
    data[~keep] = 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.tobytes()))


def count_texts(ids: list[str], texts: pa.Array, shortest: int, spoil: int | None) -> tuple[list[str], list[int]]:
    """Words of whole texts with their occurrences. `spoil`: a word loses a code point where the checksum of `<id>:<word>` is divisible by it."""
    codes, offsets, words = split_words(letters_only(texts))
    found: Counter = Counter()
    if not len(codes):
        return [], []
    key, times = np.unique(np.repeat(np.arange(len(ids)), np.diff(offsets)) * len(words) + codes, return_counts=True)
    doc, code = key // len(words), key % len(words)
    if spoil:
        h = pair_checksums([f"{i}:".encode() for i in ids], doc, words, code)
        hit = h % np.uint32(spoil) == 0
        for word, x, n in zip(words.take(pa.array(code[hit])).to_pylist(), h[hit].tolist(), times[hit].tolist()):
            at = x % len(word)
            found[word[:at] + word[at + 1 :]] += n
        code, times = code[~hit], times[~hit]
    total = np.bincount(code, weights=times, minlength=len(words)).astype(np.int64)
    long = np.asarray(pc.utf8_length(words)) >= shortest
    at = np.flatnonzero(long & (total > 0))
    more = {w: n for w, n in found.items() if len(w) >= shortest}
    return words.take(pa.array(at)).to_pylist() + list(more), total[at].tolist() + list(more.values())


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, spoil: int | None = None) -> DataFrame:
    """(word, n): words of at least `shortest` code points and `least` occurrences in all whole texts."""

    def run(batches):
        for t in batches_by_bytes(batches, "text", CHUNK):
            words, n = count_texts(array_of(t, "id").to_pylist(), array_of(t, "text"), shortest, spoil)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])
        release()

    counted = docs.select(id_text(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Trie:
    """Sorted words as a compact trie in flat arrays: the children of node i are first[i] to first[i + 1], in order of their labels."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.first, self.label, self.word = array("i"), array("i", [0]), array("i")
        queue, at, made = [(0, len(words), 0)], 0, 1
        while at < len(queue):  # by breadth, so that children lie together
            lo, hi, depth = queue[at]
            queue[at] = None
            at += 1
            self.first.append(made)
            whole = hi > lo and (hi - lo == 1 or len(words[lo]) == depth)
            self.word.append(lo if whole else -1)
            if hi - lo == 1:
                continue  # a leaf: the rest of its word stands in words
            lo += whole
            while lo < hi:
                c, end = words[lo][depth], lo + 1
                while end < hi and words[end][depth] == c:
                    end += 1
                queue.append((lo, end, depth + 1))
                self.label.append(ord(c))
                made += 1
                lo = end
        self.first.append(made)

    def _rest(self, node: int, depth: int, w: str, points: list[int], j: int) -> int:
        """The word below this node (of this depth) that goes on with exactly w[j:], or -1."""
        first, label = self.first, self.label
        while True:
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                k = self.word[node]
                return k if self.words[k][depth:] == w[j:] else -1
            if j == len(w):
                return self.word[node]
            node = bisect_left(label, points[j], lo, hi)
            if node == hi or label[node] != points[j]:
                return -1
            depth, j = depth + 1, j + 1

    def near(self, w: str) -> set[int]:
        """Places of the words at distance one from w: its automaton walked over the trie, depth first."""
        first, label, rest, points, n = self.first, self.label, self._rest, [ord(c) for c in w], len(w)
        found, node, i = set(), 0, 0
        while self.words:  # no error yet: the node spells w[:i]
            lo, hi, k = first[node], first[node + 1], self.word[node]
            if lo == hi:
                if one_edit(w[i:], self.words[k][i:]):
                    found.add(k)
                break
            if i == n - 1:
                found.add(k)  # the last code point left out
            own = points[i] if i < n else -1
            after = points[i + 1] if i + 1 < n else -1
            spine = -1
            for child in range(lo, hi):  # each spends the error, then must match exactly
                c = label[child]
                found.add(rest(child, i + 1, w, points, i))  # c put in before w[i]
                if c == own:
                    spine = child
                elif i < n:
                    found.add(rest(child, i + 1, w, points, i + 1))  # c in place of w[i]
                if c == after:
                    found.add(rest(child, i + 1, w, points, i + 2))  # w[i] left out
            if spine < 0:
                break
            node, i = spine, i + 1
        found.discard(-1)
        return {k for k in found if self.words[k] != w}


def one_edit(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < len(a) and p < len(b) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def shards(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(shard binary, size long): contiguous ranges of the vocabulary, each a pickled trie of at most shard_chars code points or of one word."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parts = -(-int(total) // shard_chars) or 1

    def run(batches):
        held, counts, size = [], [], 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(w) > shard_chars:
                    yield _packed(held, counts)
                    held, counts, size = [], [], 0
                held.append(w)
                counts.append(n)
                size += len(w)
        if held:
            yield _packed(held, counts)
        release()

    ranged = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ranged.mapInArrow(run, "shard binary, size long")


def _packed(words: list[str], counts: list[int]) -> pa.RecordBatch:
    data = pickle.dumps(Trie(words, counts))
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["shard", "size"])


def waves(built: DataFrame, wave_bytes: int):
    """Lists of pickled shards of at most wave_bytes together (or a single shard), fetched part by part."""
    held, size = [], 0
    for row in built.toLocalIterator():
        if held and size + row["size"] > wave_bytes:
            yield held
            held, size = [], 0
        held.append(bytes(row["shard"]))
        size += row["size"]
    if held:
        yield held


def meet(words: DataFrame, tries: list[bytes]) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have near words in these shards."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches):
        loaded = [pickle.loads(t) for t in shared.value]
        for batch in batches:
            out = []
            for w in batch.column(0).to_pylist():
                n_near, best = 0, None
                for t in loaded:
                    for k in t.near(w):
                        n_near += 1
                        own = (-t.counts[k], t.words[k])
                        best = own if best is None else min(best, own)
                if best:
                    out.append((w, n_near, best[1], -best[0]))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "n_near", "form", "form_n"])
        del loaded
        release()

    return words.select("word").mapInArrow(run, "word string, n_near long, form string, form_n long")


def roots(forms: DataFrame, at: str) -> DataFrame:
    """(word, root) for (word, form): every word with a form is led to the end of its path. Steps double, so rounds are few."""
    found, k = forms.select("word", F.col("form").alias("root")), 0
    while True:
        found = written(found, f"{at}/roots{k}")
        step = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = found.join(step, "root", "left")
        if jumped.filter(F.col("next").isNotNull()).isEmpty():
            return found
        found, k = jumped.select("word", F.coalesce("next", "root").alias("root")), k + 1


def variants(words: DataFrame, *, ratio: int = RATIO, shard_chars: int = SHARD_CHARS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a vocabulary of distinct words with counts.

    n_near counts the words at distance one. form is the near word of largest count (ties: smallest) if it occurs at least
    `ratio` (2 or more) times as often, else null. root ends the path of forms; a word without form is its own root.
    """
    if ratio < 2:
        raise ValueError("with a ratio below 2 forms could lead in a circle")
    spark, at = words.sparkSession, work_dir(words.sparkSession)
    words = written(words.select("word", "n"), f"{at}/words")
    built = written(shards(words, shard_chars), f"{at}/shards")
    dealt = words.repartition(-(-words.count() // TASK_WORDS) or 1)
    n = 0
    for n, tries in enumerate(waves(built, wave_bytes), 1):
        meet(dealt, tries).write.mode("overwrite").parquet(f"{at}/near/wave={n}")
    if not n:
        none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
        return none.withColumn("root", F.col("word"))
    near = spark.read.schema("word string, n_near long, form string, form_n long").parquet(*[f"{at}/near/wave={k}" for k in range(1, n + 1)])
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    reduced = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= F.col("n") * ratio
    judged = words.join(reduced, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"),
    )
    judged = written(judged, f"{at}/judged")
    ends = roots(judged.filter(F.col("form").isNotNull()), at)
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    words = vocabulary(table(spark, sf_dir, "documents"), spoil=97)
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE
steps AS (SELECT i, list_reduce(range(9), lambda s, k: CASE WHEN k = 0 THEN s WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, i) AS v FROM range(256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS tab FROM steps),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, list_concat([4294967295], list_transform(string_split(id || ':', ''), lambda c: unicode(c)::BIGINT),
    flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))) AS bs FROM pairs),
hashed AS (SELECT id, run, times, xor(list_reduce(bs, lambda s, x: xor(s >> 8, tab[CAST(xor(s, x) & 255 AS INT) + 1])), 4294967295) AS h FROM bytes, crc),
spoilt AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS form, b.n AS form_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, (min(ROW(-form_n, form)))[2] AS form, max(form_n) AS form_n FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
path AS (SELECT word, word AS root, form AS next FROM judged UNION ALL SELECT p.word, p.next, j.form FROM path p JOIN judged j ON p.next = j.word WHERE p.next IS NOT NULL)
SELECT j.word, j.form, p.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM judged j JOIN path p ON j.word = p.word AND p.next IS NULL
"""
