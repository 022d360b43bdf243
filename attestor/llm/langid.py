"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Byte n-grams of every word (with its boundaries) are hashed into a fixed number of buckets. A text is the mean of the
embeddings of all its n-grams; a linear softmax over it gives the language. The confidence is calibrated by a temperature
fitted on learning documents that training left out, and texts below the calibrated threshold are marked rejected.

Prediction reads whole texts: n-grams are hashed once per distinct word of an Arrow batch and gathered, so no text is cut.
The classifier is fitted on a bounded sample of labelled rows: of each language (the LANGS most frequent ones) at most PER_LANG
documents and LANG_BYTES bytes of texts, those with the smallest hash of id and text; nothing else is sampled. Training takes
STEPS steps at least, however few the rows. lang, source and the id are never inputs of a prediction.

Defined results: null text or text without a letter is `und` with score 0 and rejected; without any labelled row all is
`und`; with one label all else is that label; rows with a null id count as learning rows; an empty table stays empty.
The carried columns travel inside a struct, so their names cannot clash with the results'.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import array_of, batches_by_bytes, bounded_sample, id_text, release, split_words, table

#: The bound of the sample the classifier is fitted on: documents and bytes of texts of each language, and languages.
PER_LANG, LANG_BYTES, LANGS = 500, 2 << 20, 128
#: Distinct words, and bytes of texts, that prediction works on at a time.
WORD_SLICE, CHUNK = 1 << 15, 8 << 20
BUCKETS, DIM, ORDERS = 1 << 14, 16, (2, 3, 4)
EPOCHS, STEPS, BATCH, RATE = 6, 600, 64, 0.5
#: Of calibration documents that were predicted right, so many may be rejected; the threshold is held within these bounds.
REJECTED_RIGHT, LEAST, MOST = 0.001, 0.3, 0.5
UND = "und"


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]]."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: offsets[-1]], offsets[full], axis=0)
    return out


def gather_sum(rows: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows[index[offsets[i]:offsets[i+1]]], one place of all segments at a time, and long segments each on their own."""
    size = np.diff(offsets)
    out = np.zeros((len(size), rows.shape[1]), rows.dtype)
    long = size > 256
    for i in np.flatnonzero(long):
        for at in range(offsets[i], offsets[i + 1], 1 << 16):
            out[i] += rows[index[at : min(at + (1 << 16), offsets[i + 1])]].sum(0)
    order = np.argsort(np.where(long, 0, -size), kind="stable")
    left, begin = np.where(long, 0, size)[order], offsets[:-1][order]
    sums, live = np.zeros_like(out), len(size)
    for j in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left[:live], -j))
        sums[:live] += rows[index[begin[:live] + j]]
    out[order] += sums
    return out


def grams(words: pa.Array, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (a power of two) of all byte n-grams of all words, and where each word's begin."""
    n = len(words)
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), pc.utf8_lower(words) if lower else words, pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(marked, pa.ChunkedArray):
        marked = marked.combine_chunks()
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    offsets = np.frombuffer(marked.buffers()[1], np.int64, n + 1, marked.offset * 8)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    word = np.repeat(np.arange(n), np.diff(offsets))
    found, owners = [], []
    for k in orders:
        if len(data) < k:
            continue
        h = np.full(len(data) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h * np.uint64(0x100000001B3)) ^ data[j : len(data) - k + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        own = word[: len(h)]
        whole = own == word[k - 1 :]
        found.append((h[whole] >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int32))
        owners.append(own[whole])
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text's n-grams."""
    if len(texts) > 64:  # in slices, so that few texts' words are held at a time
        return [bag for at in range(0, len(texts), 64) for bag in bags(texts.slice(at, 64))]
    codes, offsets, words = split_words(texts)
    bucket, begin = grams(words)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        word, times = np.unique(codes[a:b], return_counts=True)
        lens = begin[word + 1] - begin[word]
        at = np.repeat(begin[word] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        count = np.bincount(bucket[at], weights=np.repeat(times, lens), minlength=BUCKETS) if len(at) else np.zeros(BUCKETS)
        seen = np.flatnonzero(count)
        out.append((seen.astype(np.uint16), (count[seen] / max(count.sum(), 1)).astype(np.float32)))
    return out


def fit(texts: list[str], langs: list[str], calibrate: list[bool], seed: int = 7) -> dict:
    """The model as a dict of arrays of a fixed size (about 1 MB), whatever the corpus."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    model = {"langs": names, "emb": emb, "w": np.zeros((DIM, max(len(names), 1)), np.float32), "b": np.zeros(max(len(names), 1), np.float32), "heat": 1.0, "least": LEAST}
    if len(names) < 2:
        return model
    x, y = bags(pa.array(texts, pa.large_string())), np.array([names.index(v) for v in langs])
    held = np.array(calibrate)
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    epochs = max(EPOCHS, -(-STEPS // -(-len(train) // BATCH)))
    steps, done = epochs * (-(-len(train) // BATCH)), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            dense = np.zeros((len(rows), BUCKETS), np.float32)
            for i, r in enumerate(rows):
                dense[i, x[r][0]] = x[r][1]
            hidden = dense @ emb
            p = _softmax(hidden @ model["w"] + model["b"])
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            rate = RATE * (1 - done / steps) * 10
            back = dense.T @ (p @ model["w"].T)
            model["w"] -= rate * (hidden.T @ p)
            model["b"] -= rate * p.sum(0)
            emb -= rate * 10 * back
            done += 1
    cal = np.flatnonzero(held) if held.any() else train
    logits = np.stack([x[r][1] @ emb[x[r][0]] for r in cal]) @ model["w"] + model["b"]
    model["heat"] = float(min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(cal)), y[cal]] + 1e-9).mean()))
    p = _softmax(logits / model["heat"])
    right = p.max(1)[p.argmax(1) == y[cal]]
    model["least"] = float(np.clip(np.quantile(right, REJECTED_RIGHT), LEAST, MOST)) if len(right) else LEAST
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> dict:
    """Fit on a bounded sample of the rows with text and language whose id's crc32 modulo 4 is not 2."""
    crc = F.crc32(id_text(id_col).cast("binary"))
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), crc.alias("crc"), id_text(id_col).alias("id")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("crc") % 4 != 2))
    drawn = bounded_sample(known, of=F.col("lang"), key=F.xxhash64("id", "text"), rows_=per_lang, size=LANG_BYTES, classes=LANGS)
    sample = drawn.select("text", "lang", (F.col("crc") % 4 == 3).alias("cal"), "key").toPandas().sort_values(["key", "lang", "text"])
    model = fit(list(sample["text"]), list(sample["lang"]), list(sample["cal"]))
    del sample
    release()
    return model


def predict_texts(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language or -1, calibrated confidence) of whole texts."""
    codes, offsets, words = split_words(texts)
    n = len(offsets) - 1
    best, score = np.full(n, -1), np.zeros(n)
    if not model["langs"] or not len(words):
        return best, score
    vec = np.zeros((len(words), DIM + 2), np.float32)
    vec[:, DIM + 1] = np.asarray(pc.match_substring_regex(words, r"\p{L}"))
    for at in range(0, len(words), WORD_SLICE):  # so that the n-grams held at a time stay few
        bucket, begin = grams(words.slice(at, WORD_SLICE))
        vec[at : at + WORD_SLICE, :DIM] = gather_sum(model["emb"], bucket, begin)
        vec[at : at + WORD_SLICE, DIM] = np.diff(begin)
    step = 1 << 17
    sums = np.zeros((n, DIM + 2), np.float32)
    at = 0
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, "right")) - 1))
        sums[at:to] = gather_sum(vec, codes[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    has = sums[:, DIM + 1] > 0
    mean = sums[:, :DIM] / np.maximum(sums[:, DIM : DIM + 1], 1)
    p = _softmax((mean @ model["w"] + model["b"]) / model["heat"])
    best[has], score[has] = p.argmax(1)[has], p.max(1)[has]
    return best, score


def identify(docs: DataFrame, model: dict, *, carry: list[str], text_col: str = "text") -> DataFrame:
    """(doc struct<carry...>, lang_pred, score, rejected), a row for each row of docs."""
    inside = text_col in carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] + ([] if inside else [F.col(text_col).alias("text")])
    picked = docs.select(*cols)
    schema = T.StructType([picked.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        m = shared.value
        names = pa.array([*m["langs"], UND])
        for t in batches_by_bytes(batches, "doc" if inside else "text", CHUNK):
            doc = array_of(t, "doc")
            best, score = predict_texts(pc.struct_field(doc, text_col) if inside else array_of(t, "text"), m)
            best = np.where(best < 0, len(m["langs"]), best)
            yield from pa.table({"doc": doc, "lang_pred": names.take(pa.array(best)), "score": pa.array(score), "rejected": pa.array((best == len(m["langs"])) | (score < m["least"]))}).to_batches()

    return picked.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs)
    docs = docs.withColumn("held_out", F.crc32(id_text("doc_id").cast("binary")) % 4 == 2)
    return identify(docs, model, carry=["doc_id", "held_out"]).select("doc.doc_id", "doc.held_out", "lang_pred", "score", "rejected")
