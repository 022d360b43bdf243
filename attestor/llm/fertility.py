"""Quality rules by tokeniser fertility.

A public vocabulary (a parameter; never trained here) tells how text-like a text is: characters per token, the share of
byte-fallback tokens and the entropy of its tokens. Each language, or else each script, has a band for these figures;
documents outside are rejected. Counts that need no tokeniser are made in the same pass over the whole text: word
characters, symbols, repeated lines and words inside repeated 5-word windows.

Every distinct word of an Arrow batch is tokenised once and gathered, so whole texts of any length cost bounded memory.

Defined results: null text is empty text; a text without words has all counts 0 and fails the base rule; figures of
tokens are null when there are no tokens; texts of fewer than LEAST_TOKENS tokens are not held to the entropy band;
repeated rows are judged each; an empty table stays empty. Carried columns travel inside a struct.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import array_of, batches_by_bytes, split_words, table
from attestor.llm.langid import segment_sum

VOCABULARY = "piece_bpe_32k.model"
#: Tokens (log2, 64 to 8192) at which the least entropy of a band is given; between them it is interpolated, beyond it stays.
KNOTS = [6, 7, 8, 9, 10, 11, 12, 13]
#: (least and most characters per token, most share of byte tokens, least entropy in bits, at each of KNOTS or at any
#: length). Entropy grows with length, so what is too low depends on it: the curves of the languages are fitted to the
#: labelled good documents of sf0.1 whose crc32(doc_id) is even, at a cost of 0.5 % of them; those of 64 to 128 tokens are
#: few, so the first knot is lowered until all of these pass. "latin" is the
#: lowest of the four. There is no labelled text of the other scripts: theirs are flat and unmeasured.
BANDS = {
    "en": (1.35, 9.0, 0.15, (4.62, 5.63, 6.03, 6.36, 6.60, 6.76, 6.85, 6.85)), "de": (1.35, 9.0, 0.15, (4.57, 5.54, 5.91, 6.21, 6.43, 6.56, 6.62, 6.62)),
    "fr": (1.35, 9.0, 0.15, (4.57, 5.53, 5.89, 6.17, 6.38, 6.50, 6.55, 6.55)), "es": (1.35, 9.0, 0.15, (4.45, 5.45, 5.85, 6.16, 6.40, 6.56, 6.64, 6.64)),
    "latin": (1.2, 9.0, 0.25, (4.45, 5.45, 5.85, 6.16, 6.38, 6.50, 6.55, 6.55)), "cyrillic": (1.0, 8.0, 0.25, 3.0), "greek": (0.6, 8.0, 0.6, 2.5),
    "arabic": (0.6, 8.0, 0.6, 2.5), "cjk": (0.3, 4.0, 0.9, 2.5), "other": (0.3, 9.0, 1.0, 2.5),
}
LEAST_TOKENS = 64
#: Distinct words, and bytes of texts, that are worked on at a time.
WORD_SLICE, CHUNK = 1 << 15, 8 << 20
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: First code points of ranges, and the script of each. Fixed values.
SCRIPT_STARTS = [0x0000, 0x0370, 0x0400, 0x0530, 0x0600, 0x0780, 0x1E00, 0x2000, 0x3040, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000]
SCRIPTS = ["latin", "greek", "cyrillic", "other", "arabic", "other", "latin", "other", "cjk", "other", "cjk", "other", "cjk", "other", "cjk"]
KINDS = ["latin", "cyrillic", "greek", "arabic", "cjk", "other"]
_loaded: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _pieces(path: str):
    if path not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = sp, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    return _loaded[path]


def repeat_words(codes: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of each text, the words that lie in a window of `width` words found twice or more in it."""
    n = len(codes)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(np.arange(n) + width <= offsets[doc + 1]) if n else np.zeros(0, np.int64)
    cover = np.zeros(n + 1, np.int32)
    if len(start):
        key = doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(width):
            key = (key ^ codes[start + j].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        a, b = start[order[:-1]], start[order[1:]]
        near = np.flatnonzero(key[order[:-1]] == key[order[1:]])
        a, b = a[near], b[near]
        same = doc[a] == doc[b]
        for j in range(width):  # equal hashes are confirmed word by word
            same &= codes[a + j] == codes[b + j]
        found = np.unique(np.concatenate([a[same], b[same]]))
        np.add.at(cover, found, 1)
        np.add.at(cover, found + width, -1)
    return segment_sum((np.cumsum(cover[:n]) > 0).astype(np.int64), offsets)


def dup_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, path: str) -> dict[str, np.ndarray]:
    """All counts and figures of whole texts."""
    codes, offsets, words = split_words(texts)
    n = len(offsets) - 1
    sp, is_byte = _pieces(path)
    n_distinct = len(words)
    lens, per = np.zeros(n_distinct, np.int64), np.zeros((n_distinct, 4 + len(KINDS)), np.int64)
    first, flats = np.zeros(n_distinct, np.int64), []
    for at in range(0, n_distinct, WORD_SLICE):  # so that few lists of tokens are held at a time
        listed = words.slice(at, WORD_SLICE).to_pylist()
        encoded = sp.encode(listed, num_threads=1)
        lens[at : at + len(listed)] = np.fromiter(map(len, encoded), np.int64, len(listed))
        flats.append(np.fromiter(chain.from_iterable(encoded), np.int32))
        first[at : at + len(listed)] = np.fromiter((ord(next(filter(str.isalpha, w), "\0")) for w in listed), np.int64, len(listed))
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    begin = np.concatenate([[0], np.cumsum(lens)])
    kind = np.array([KINDS.index(s) for s in SCRIPTS])[np.searchsorted(SCRIPT_STARTS, first, "right") - 1]
    if n_distinct:
        per[:, 0] = np.asarray(pc.utf8_length(words))
        per[:, 1] = np.asarray(pc.count_substring_regex(words, "[#*$%&|<>]"))
        per[:, 2], per[:, 3] = lens, segment_sum(is_byte[flat].astype(np.int64), begin)
        per[np.flatnonzero(first), 4 + kind[first > 0]] = per[np.flatnonzero(first), 0]
    sums, entropy = np.zeros((n, per.shape[1]), np.int64), np.full(n, np.nan)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 17), "right")) - 1))
        own = codes[offsets[at] : offsets[to]]
        sums[at:to] = segment_sum(per[own], offsets[at : to + 1] - offsets[at])
        size = lens[own]
        if total := int(size.sum()):
            token = flat[np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(total)].astype(np.int64)
            key = np.sort(np.repeat(np.arange(to - at), sums[at:to, 2]) * (1 << 20) + token)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(edge, total)).astype(np.float64)
            whose = key[edge] >> 20
            got = np.bincount(whose, weights=count * np.log2(count), minlength=to - at)
            t = sums[at:to, 2]
            entropy[at:to] = np.where(t > 0, np.log2(np.maximum(t, 1)) - got / np.maximum(t, 1), np.nan)
        at = to
    tokens = sums[:, 2]
    with np.errstate(invalid="ignore", divide="ignore"):
        return {
            "n_words": np.diff(offsets), "word_chars": sums[:, 0], "n_symbols": sums[:, 1], "n_repeat_words": repeat_words(codes, offsets),
            "n_dup_lines": np.fromiter((dup_lines(t.as_py()) for t in texts), np.int64, n), "n_tokens": tokens,
            "chars_per_token": np.where(tokens > 0, sums[:, 0] / tokens, np.nan), "byte_share": np.where(tokens > 0, sums[:, 3] / tokens, np.nan), "entropy": entropy,
            "script": np.where(sums[:, 4:].any(1), sums[:, 4:].argmax(1), KINDS.index("other")),
        }


def in_band(m: dict[str, np.ndarray], langs: list, bands: dict = BANDS) -> np.ndarray:
    """Whether each text lies within the band of its language, or where that has none, of its script."""
    names = np.array([v if v in bands else KINDS[s] for v, s in zip(langs, m["script"])], object)
    ok, size = np.zeros(len(names), bool), np.log2(np.maximum(m["n_tokens"], 1))
    for name in set(names):
        i = np.flatnonzero(names == name)
        low, high, most, curve = bands[name]
        least = np.interp(size[i], KNOTS, np.broadcast_to(curve, len(KNOTS)))
        ok[i] = (m["chars_per_token"][i] >= low) & (m["chars_per_token"][i] <= high) & (m["byte_share"][i] <= most) & ((m["n_tokens"][i] < LEAST_TOKENS) | (m["entropy"][i] >= least))
    return ok


def judge(docs: DataFrame, *, carry: list[str], text_col: str = "text", lang_col: str | None = "lang", path: str | None = None, bands: dict = BANDS) -> DataFrame:
    """(doc struct<carry...>, counts, figures, base_failed, kept), a row for each row of docs."""
    path = path or vocabulary_path()
    inside = text_col in carry
    lang = F.col(lang_col) if lang_col else F.lit(None)
    picked = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), lang.cast("string").alias("lang"), *([] if inside else [F.col(text_col).alias("text")]))
    longs, doubles = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], ["chars_per_token", "byte_share", "entropy"]
    schema = T.StructType([picked.schema["doc"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in doubles]])

    def run(batches):
        for t in batches_by_bytes(batches, "doc" if inside else "text", CHUNK):
            doc = array_of(t, "doc")
            m = measure(pc.struct_field(doc, text_col) if inside else array_of(t, "text"), path)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_PERCENT * m["n_words"])
            kept = ~failed & in_band(m, array_of(t, "lang").to_pylist(), bands)
            cols = {"doc": doc} | {c: pa.array(m[c], pa.int64()) for c in longs} | {"base_failed": pa.array(failed), "kept": pa.array(kept), "n_tokens": pa.array(m["n_tokens"], pa.int64())} | {c: pa.array(m[c], pa.float64(), from_pandas=True) for c in doubles}
            yield from pa.table(cols).to_batches()

    return picked.mapInArrow(run, schema)


def op10_fertility_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")
