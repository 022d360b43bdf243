"""Fill-in-the-middle by a parallel automaton scan over bytes.

A deterministic automaton reads UTF-8 bytes, counts the units (code points, or lines) that end and the control strings that
occur. A chunk doesn't know the state it is entered in, so it emits a function: for each state it could start in, the state it
ends in and its counts. Functions compose associatively; composing a document's chunks in order gives each its true entry
state and the units before it. A cut after k units lies in the first chunk whose units reach k: only that chunk is read again.

Documents up to GIANT bytes are scanned where they lie, all chunks of a batch in step. Longer ones are cut into blocks of
BLOCK bytes that Spark deals out by size; each block is reduced to one function by a tree, a document's functions (at most
2 GB / BLOCK, as no value is longer) are composed in one group, and the cuts are found in their blocks alone. Both ways run
the same automaton and give the same rows.

Defined results: null and empty texts are plain with n = 0; a null id counts as the empty text in the hash; repeated rows give
repeated rows; malformed UTF-8 counts each broken sequence as one unit and is kept byte for byte; an empty table stays empty.
The carried columns travel inside a struct, so their names cannot clash with the results'.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import array_of, batches_by_bytes, id_text, release, table, work_dir, written

#: Control strings for prefix, suffix and middle.
CONTROLS = ("<P>", "<S>", "<M>")
#: Bytes: of a chunk that is scanned in step with others, of a block of a giant document, beyond which a document is one, and of texts held at a time.
CHUNK, BLOCK, GIANT, HELD = 2048, 1 << 20, 1 << 20, 8 << 20
#: Of 100 documents so many are rearranged, and of these so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Counts hold units below this bit and control strings above.
MARK = np.int64(1 << 40)


class Automaton:
    """Tables over (state, class of byte): next state and counts. `last` are the units that the end of a text ends. State 0 starts."""

    def __init__(self, controls: tuple[str, ...] = CONTROLS, unit: str = "code_point"):
        marks = [c.encode("ascii") for c in controls]
        stems = sorted({m[:k] for m in marks for k in range(len(m))} | {b""})
        # what tells bytes apart: letters of control strings, line ends, and their part in UTF-8
        kinds = [*sorted({bytes([b]) for m in marks for b in m} | {b"\n"}), "ascii", "more", 1, 2, 3]
        self.classes = np.array([kinds.index(_kind(b, kinds)) for b in range(256)], np.int64)
        names, self.next, self.emit = [(0, b"")], [], []
        for pending, stem in names:  # grows while it is read
            row, counts = [], []
            for kind in kinds:
                ended, then = _utf8(pending, kind)
                seen = stem + kind if isinstance(kind, bytes) else b""
                hit = any(seen.endswith(m) for m in marks)
                seen = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in stems)
                if unit == "line":
                    ended, then = int(kind == b"\n"), int(kind != b"\n")
                if (then, seen) not in names:
                    names.append((then, seen))
                row.append(names.index((then, seen)))
                counts.append(ended + (int(MARK) if hit else 0))
            self.next.append(row)
            self.emit.append(counts)
        self.next, self.emit = np.array(self.next, np.int64), np.array(self.emit, np.int64)
        self.last = np.array([int(pending > 0) for pending, _ in names], np.int64)
        self.states = len(names)


def _kind(byte: int, kinds: list):
    if bytes([byte]) in kinds:
        return bytes([byte])
    return "ascii" if byte < 0x80 else "more" if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3


def _utf8(pending: int, kind) -> tuple[int, int]:
    """(units ended, bytes still to come) after a byte; what breaks a sequence off ends its unit."""
    if kind == "more":
        return (int(pending <= 1), max(pending - 1, 0))
    broken = int(pending > 0)
    return (broken, kind) if isinstance(kind, int) else (broken + 1, 0)


def scan(data: np.ndarray, begin: np.ndarray, size: np.ndarray, auto: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The functions of chunks data[begin : begin + size]: (end state, counts) for each chunk and start state, all chunks in step."""
    order = np.argsort(-size, kind="stable")
    at, left, wide = begin[order], size[order], auto.next.shape[1]
    ends = np.tile(np.arange(auto.states), (len(size), 1))
    counts = np.zeros_like(ends)
    follow, emit = auto.next.ravel(), auto.emit.ravel()
    live = len(size)
    for j in range(int(left[0]) if len(left) else 0):
        while left[live - 1] <= j:
            live -= 1
        cell = ends[:live] * wide + auto.classes[data[at[:live] + j]][:, None]
        counts[:live] += emit[cell]
        ends[:live] = follow[cell]
    back = np.argsort(order, kind="stable")
    return ends[back], counts[back]


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The functions of chunks followed by their right neighbours; associative."""
    return np.take_along_axis(then[0], first[0], -1), first[1] + np.take_along_axis(then[1], first[0], -1)


def reduce(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One function for chunks in order, composed pairwise in a tree."""
    while len(ends) > 1:
        odd = len(ends) % 2
        pair = compose((ends[: len(ends) - odd : 2], counts[: len(ends) - odd : 2]), (ends[1::2], counts[1::2]))
        ends, counts = (np.concatenate([p, rest[len(rest) - odd :]]) for p, rest in zip(pair, (ends, counts)))
    return ends[0], counts[0]


def locate(data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray, units: np.ndarray, auto: Automaton) -> np.ndarray:
    """Bytes of each chunk, entered in its true state, up to the end of its units-th unit; all of it if the text's end ends that unit."""
    order = np.argsort(-size, kind="stable")
    at, left, now, want, wide = begin[order], size[order], state[order], units[order], auto.next.shape[1]
    out, done, live = np.where(want > 0, left, 0), want <= 0, len(size)
    for j in range(int(left[0]) if len(left) else 0):
        while left[live - 1] <= j:
            live -= 1
        cell = now[:live] * wide + auto.classes[data[at[:live] + j]]
        want[:live] -= auto.emit.ravel()[cell] % MARK
        now[:live] = auto.next.ravel()[cell]
        fresh = np.flatnonzero((want[:live] <= 0) & ~done[:live])
        out[fresh] = j + 1
        done[fresh] = True
    return out[np.argsort(order, kind="stable")]


def chunks_of(offsets: np.ndarray, step: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, size) of the chunks of texts that lie at these offsets; an empty text has one empty chunk."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // step))
    doc = np.repeat(np.arange(len(size)), n)
    no = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, offsets[doc] + no * step, np.minimum(step, size[doc] - no * step)


def decide(id_: str, n: int, marked: bool, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """(form, units of the prefix, units up to the end of the middle), by the hash of the id."""
    digest = hashlib.sha256(f"1:{id_}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("plain" if not n or marked or h3 % 100 >= rearranged else "spm" if h4 % 100 < suffix_first else "psm"), a, b


def arranged(text: bytes, form: str, a: int, b: int, controls: tuple[str, ...] = CONTROLS) -> bytes:
    p, s, m = (c.encode() for c in controls)
    if form == "plain":
        return text
    return p + text[:a] + s + text[b:] + m + text[a:b] if form == "psm" else s + text[b:] + p + text[:a] + m + text[a:b]


def restored(output: Column, form: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The text, from output and form alone. Texts that hold a control string are plain, so the three found are the operator's own."""
    parts = F.split(output, "|".join(rf"\Q{c}\E" for c in controls), -1)
    first, second, third = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


class Rows:
    """Rows of the result for a table of texts, with `doc` carried along."""

    def __init__(self, auto: Automaton, controls: tuple[str, ...], rates: tuple[int, int]):
        self.auto, self.controls, self.rates = auto, controls, rates

    def table(self, doc: pa.Array, texts: list[bytes], n: list[int], decided: list[tuple[str, int, int]], cuts: np.ndarray) -> pa.Table:
        out = [arranged(t, form, a, b, self.controls) for t, (form, _, _), (a, b) in zip(texts, decided, cuts.tolist())]
        plain = np.array([d[0] == "plain" for d in decided], bool)
        units = np.array([d[1:] for d in decided], np.int64).reshape(-1, 2)
        return pa.table({
            "doc": doc, "n": pa.array(n, pa.int64()), "form": pa.array([d[0] for d in decided], pa.string()), "prefix_units": pa.array(units[:, 0], mask=plain),
            "middle_units": pa.array(units[:, 1] - units[:, 0], mask=plain), "output": pa.array(out, pa.binary()),
        })

    def whole(self, doc: pa.Array, ids: list[str], texts: pa.Array) -> pa.Table:
        """Documents scanned where they lie."""
        auto, texts = self.auto, texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        owner, begin, size = chunks_of(offsets)
        ends, counts = scan(data, begin, size, auto)
        first = np.searchsorted(owner, np.arange(len(ids) + 1))
        entry, state, total, reached = np.zeros(len(owner), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(owner), np.int64)
        for k in range(int(np.diff(first).max(initial=0))):  # the k-th chunk of all documents that have one
            on = np.flatnonzero(first[1:] - first[:-1] > k)
            c = first[on] + k
            entry[c] = state[on]
            total[on] += counts[c, state[on]]
            state[on] = ends[c, state[on]]
            reached[c] = total[on] % MARK
        n = total % MARK + auto.last[state]
        decided = [decide(i, int(m), bool(x), *self.rates) for i, m, x in zip(ids, n, total >= MARK)]
        want = np.array([d[1:] for d in decided], np.int64).reshape(-1, 2)
        # the first chunk of a document that reaches the wanted units, else its last: all documents' chunks as one ascending line
        span = int(n.max(initial=0)) + 2
        line = reached + owner * span
        cuts = np.zeros((len(ids), 2), np.int64)
        for side in (0, 1):
            c = np.minimum(np.searchsorted(line, want[:, side] + np.arange(len(ids)) * span), first[1:] - 1)
            before = np.where(c > first[:-1], reached[c - 1], 0)
            cuts[:, side] = begin[c] - offsets[:-1] + locate(data, begin[c], size[c], entry[c], want[:, side] - before, auto)
        return self.table(doc, texts.to_pylist(), n.tolist(), decided, cuts)


def transform(
    docs: DataFrame, *, carry: list[str], id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", controls: tuple[str, ...] = CONTROLS,
    rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, giant: int = GIANT, block: int = BLOCK,
) -> DataFrame:
    """(doc struct<carry...>, n, form, prefix_units, middle_units, output), a row for each row of docs."""
    spark = docs.sparkSession
    rows = Rows(Automaton(controls, unit), controls, (rearranged, suffix_first))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), id_text(id_col).alias("id"), text.alias("text"))
    schema = T.StructType([given.schema["doc"], *T.StructType.fromDDL("n long, form string, prefix_units long, middle_units long, output binary").fields])

    def near(batches):
        for t in batches_by_bytes(batches, "text", HELD):
            yield from rows.whole(array_of(t, "doc"), array_of(t, "id").to_pylist(), array_of(t, "text")).to_batches()
        release()

    done = given.filter(F.octet_length("text") <= giant).mapInArrow(near, schema)
    large = given.filter(F.octet_length("text") > giant)
    if not large.isEmpty():
        done = done.unionByName(_giants(large, rows, schema, block, work_dir(spark)))
    return done.withColumn("output", F.col("output").cast("string"))


def _giants(large: DataFrame, rows: Rows, schema: T.StructType, block: int, at: str) -> DataFrame:
    """Rows of giant documents. Alike rows (by id and digest) are scanned each, but composed once."""
    auto = rows.auto
    large = large.withColumn("digest", F.sha2("text", 256))
    pieces = F.expr(f"transform(sequence(0, CAST((octet_length(text) - 1) DIV {block} AS INT)), i -> substring(text, i * {block} + 1, {block}))")
    blocks = large.select("id", "digest", pieces.alias("pieces")).select("id", "digest", F.posexplode("pieces").alias("no", "bytes")).hint("rebalance")

    def functions(batches):
        for batch in batches:
            out = []
            for b in batch.column(3):
                data = np.frombuffer(b.as_buffer(), np.uint8)
                _, begin, size = chunks_of(np.array([0, len(data)]))
                out.append(reduce(*scan(data, begin, size, auto)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([f[k].tolist() for f in out], pa.list_(pa.int64())) for k in (0, 1))], ["id", "digest", "no", "ends", "counts"])
        release()

    found = blocks.mapInArrow(functions, "id string, digest string, no int, ends array<long>, counts array<long>")
    found = written(found.groupBy("id", "digest", "no").agg(F.any_value("ends").alias("ends"), F.any_value("counts").alias("counts")), f"{at}/functions")

    def resolve(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("no")
        entry, before, state, total = [], [], 0, 0
        for ends, counts in zip(one["ends"], one["counts"]):
            entry.append(state)
            before.append(total % int(MARK))
            state, total = int(ends[state]), total + int(counts[state])
        n = total % int(MARK) + int(auto.last[state])
        id_, digest = one["id"].iloc[0], one["digest"].iloc[0]
        form, a, b = decide(id_, n, total >= MARK, *rows.rates)
        sides = [max(0, int(np.searchsorted(before, k)) - 1) for k in (a, b)]  # the block in which k units are reached
        return pd.DataFrame([{"id": id_, "digest": digest, "n": n, "form": form, "a": a, "b": b, "places": [[s, entry[s], k - before[s]] for s, k in zip(sides, (a, b))]}])

    decided = found.groupBy("id", "digest").applyInPandas(resolve, "id string, digest string, n long, form string, a long, b long, places array<array<long>>")

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1)
                one = r.drop_columns(["doc"]).to_pylist()[0]
                data = np.frombuffer(one["text"], np.uint8)
                cuts = []
                for no, state, units in one["places"]:
                    size = np.array([min(block, len(data) - no * block)])
                    cuts.append(no * block + int(locate(data, np.array([no * block]), size, np.array([state]), np.array([units]), auto)[0]))
                yield from rows.table(r.column("doc"), [one["text"]], [one["n"]], [(one["form"], one["a"], one["b"])], np.array([cuts])).to_batches()
        release()

    return large.join(decided, ["id", "digest"]).select("doc", "text", "n", "form", "a", "b", "places").mapInArrow(finish, schema)


def op12_fim_scan(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return made.select(
        "doc.doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP12_SQL = """
WITH given AS (SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
hashed AS (
  SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3,
    CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM given),
cut AS (
  SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""
