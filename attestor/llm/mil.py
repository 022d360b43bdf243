"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as a vector: hashed byte n-grams of its words, averaged
in a learned embedding, and a few figures of the passage, through a hyperbolic tangent. A gated attention network (tanh times
sigmoid) gives each passage a weight; weights sum to one over the document, and the label is a logistic function of the
weighted passage vector. Only documents have labels: what makes a passage matter is learned from them.

All weights are trained together by Adam in numpy. The sample is bounded: at most SAMPLE_ROWS labelled documents, those with
the smallest hashes of id and text, and at most SAMPLE_BYTES of texts; a tenth of it is held back to choose the epoch and to
calibrate scores by a temperature. Scoring reads whole texts, all passages of an Arrow batch at a time.

Defined results: null and empty texts are one passage without words and get its score; without usable labels every score is
0.5; with labels of one kind, that kind's share (smoothed); repeated rows are scored each; rows with null ids take no part in
learning; an empty table stays empty. The carried columns travel inside a struct, so their names cannot clash with the results'.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.common import array_of, batches_by_bytes, bounded_sample, id_text, release, split_words, table
from attestor.llm.langid import gather_sum, grams

#: Words of a passage.
PASSAGE = 64
#: The bound of the sample that the model is fitted on, in documents and in bytes of texts.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 24 << 20
BUCKETS, ORDERS, FIGURES, HIDDEN, GATE = 1 << 12, (1, 2, 3), 4, 16, 12
STEPS, EPOCHS, BATCH, RATE, DECAY = 600, 12, 48, 0.01, 1e-4
#: Bytes of texts, distinct words and tokens that scoring works on at a time.
CHUNK, WORD_SLICE, TOKENS = 8 << 20, 1 << 15, 1 << 17


def passages(codes: np.ndarray, offsets: np.ndarray, n_words: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first passage of each document and the end, first token of each passage and the end, figures of each passage)."""
    count = np.maximum(1, -(-np.diff(offsets) // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    begin = np.append(np.minimum(offsets[doc] + (np.arange(first[-1]) - first[doc]) * PASSAGE, offsets[doc + 1]), offsets[-1])
    tokens = np.diff(begin)
    owner = np.repeat(np.arange(len(tokens)), tokens)
    used = codes[offsets[0] : offsets[-1]]
    pair = np.sort(owner * max(n_words, 1) + used)
    fresh = pair[np.flatnonzero(np.diff(pair, prepend=-1))]
    distinct = np.bincount(fresh // max(n_words, 1), minlength=len(tokens))
    length = np.bincount(owner, weights=sizes[used], minlength=len(tokens))
    full = np.maximum(tokens, 1)
    figures = np.stack([distinct / full, length / full / 10, np.log1p(tokens) / 5, np.log1p(np.diff(first)[doc]) / 5], 1)
    return first, begin, figures.astype(np.float32)


def bags(texts: pa.Array) -> list[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For each text: figures of its passages, and (buckets, shares) of each passage's n-grams."""
    out = []
    for at in range(0, len(texts), 64):
        codes, offsets, words = split_words(texts.slice(at, 64))
        bucket, where = grams(words, ORDERS, BUCKETS, lower=False)
        first, begin, figures = passages(codes, offsets, len(words), np.asarray(pc.utf8_length(words)))
        made = []
        for a, b in zip(begin[:-1], begin[1:]):
            word, times = np.unique(codes[a:b], return_counts=True)
            lens = where[word + 1] - where[word]
            place = np.repeat(where[word] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            count = np.bincount(bucket[place], weights=np.repeat(times, lens), minlength=BUCKETS)
            seen = np.flatnonzero(count)
            made.append((seen.astype(np.uint16), (count[seen] / max(count.sum(), 1)).astype(np.float32)))
        out += [(figures[a:b], made[a:b]) for a, b in zip(first[:-1], first[1:])]
    return out


def start(rng: np.random.Generator) -> dict:
    """Weights before training; about 0.5 MB, whatever the corpus."""
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {
        "emb": rng.normal(0, 0.1, (BUCKETS, HIDDEN)).astype(np.float32), "fig": draw(FIGURES, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE),
        "w": draw(GATE), "c": draw(HIDDEN), "b0": np.zeros(1, np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def attend(mean: np.ndarray, figures: np.ndarray, first: np.ndarray, m: dict) -> dict:
    """From the mean embeddings of passages to the documents' logits, keeping what the gradients need."""
    h = np.tanh(mean + figures @ m["fig"] + m["b1"])
    t, g = np.tanh(h @ m["v"]), sigmoid(h @ m["u"])
    s = (t * g) @ m["w"]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    e = np.exp(s - np.maximum.reduceat(s, first[:-1])[doc])
    a = e / np.add.reduceat(e, first[:-1])[doc]
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "doc": doc, "logit": z @ m["c"] + m["b0"]}


def gradients(x: np.ndarray, figures: np.ndarray, first: np.ndarray, y: np.ndarray, m: dict) -> tuple[float, dict]:
    """Mean log loss of documents and its gradients; x holds the passages' n-gram shares."""
    f = attend(x @ m["emb"], figures, first, m)
    p = sigmoid(f["logit"])
    loss = float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)))
    dl = ((p - y) / len(y)).astype(np.float32)
    dz = dl[:, None] * m["c"]
    dh = f["a"][:, None] * dz[f["doc"]]
    da = (f["h"] * dz[f["doc"]]).sum(1)
    ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[f["doc"]])
    dt, dg = ds[:, None] * m["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * m["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh += dt @ m["v"].T + dg @ m["u"].T
    dx = dh * (1 - f["h"] ** 2)
    return loss, {
        "emb": x.T @ dx, "fig": figures.T @ dx, "b1": dx.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dl, "b0": dl.sum(keepdims=True),
    }


def _dense(bag: list, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(bag[r][1]) for r in rows])])
    x = np.zeros((first[-1], BUCKETS), np.float32)
    for i, (seen, share) in enumerate(p for r in rows for p in bag[r][1]):
        x[i, seen] = share
    return x, np.concatenate([bag[r][0] for r in rows]), first


def _logits(bag: list, rows: np.ndarray, m: dict) -> np.ndarray:
    out = [np.zeros(0)]
    for at in range(0, len(rows), BATCH):
        x, figures, first = _dense(bag, rows[at : at + BATCH])
        out.append(attend(x @ m["emb"], figures, first, m)["logit"])
    return np.concatenate(out)


def fit(texts: list[str], labels: list[int], seed: int = 5) -> dict:
    """The model as a dict of arrays of a fixed size."""
    rng, y = np.random.default_rng(seed), np.array(labels, np.float32)
    m = start(rng) | {"heat": 1.0}
    if len(np.unique(y)) < 2:  # nothing to tell apart: a constant score
        share = (y.sum() + 1) / (len(y) + 2)
        return m | {"c": np.zeros(HIDDEN, np.float32), "b0": np.array([np.log(share / (1 - share))], np.float32)}
    bag = bags(pa.array(texts, pa.large_string()))
    order = rng.permutation(len(y))
    held, train = order[: len(y) // 10], order[len(y) // 10 :]
    names = [k for k in m if k != "heat"]
    mean, square = ({k: np.zeros_like(m[k]) for k in names} for _ in range(2))
    epochs = max(EPOCHS, -(-STEPS // -(-len(train) // BATCH)))
    steps, done, best = epochs * -(-len(train) // BATCH), 0, (np.inf, m)
    for _ in range(epochs):
        rng.shuffle(train)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            _, grad = gradients(*_dense(bag, rows), y[rows], m)
            done += 1
            rate = RATE * (1 - done / steps) + 1e-4
            for k in names:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                square[k] = 0.99 * square[k] + 0.01 * grad[k] ** 2
                m[k] = m[k] * (1 - rate * DECAY) - rate * (mean[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.99**done)) + 1e-8)
        if len(held):
            p = sigmoid(_logits(bag, held, m))
            loss = -np.mean(np.log(np.where(y[held] > 0, p, 1 - p) + 1e-9))
            if loss < best[0]:
                best = (loss, {k: v.copy() if k != "heat" else v for k, v in m.items()})
    m = best[1] if len(held) else m
    if len(np.unique(y[held])) == 2:
        logit = _logits(bag, held, m)
        m["heat"] = float(min(np.geomspace(0.5, 4, 25), key=lambda t: -np.mean(np.log(np.where(y[held] > 0, sigmoid(logit / t), sigmoid(-logit / t)) + 1e-9))))
    return m


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 1, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> dict:
    """Fit on a bounded sample of labelled documents, leaving out ids whose crc32 modulo 3 is `held_out`."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 3 != held_out)
    )
    # the labels are drawn first, so that few texts meet them: at most `rows` ids, sent to all tasks
    drawn = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(F.broadcast(drawn), "id")
    sample = bounded_sample(met, of=F.lit(0), key=F.xxhash64("id", "text"), rows_=rows, size=size).toPandas().sort_values(["key", "label", "text"])
    model = fit(list(sample["text"]), list(sample["label"]))
    del sample
    release()
    return model


def score_texts(texts: pa.Array, m: dict) -> np.ndarray:
    """Scores of whole texts, from 0 to 1."""
    codes, offsets, words = split_words(texts)
    if len(offsets) == 1:
        return np.zeros(0)
    vec = np.zeros((max(len(words), 1), HIDDEN + 1), np.float32)
    for at in range(0, len(words), WORD_SLICE):
        bucket, where = grams(words.slice(at, WORD_SLICE), ORDERS, BUCKETS, lower=False)
        vec[at : at + WORD_SLICE, :HIDDEN] = gather_sum(m["emb"], bucket, where)
        vec[at : at + WORD_SLICE, HIDDEN] = np.diff(where)
    first, begin, figures = passages(codes, offsets, len(words), np.asarray(pc.utf8_length(words)))
    sums = np.zeros((len(begin) - 1, HIDDEN + 1), np.float32)
    step = max(1, TOKENS // PASSAGE)
    for at in range(0, len(sums), step):
        cut = begin[at : at + step + 1]
        sums[at : at + step] = gather_sum(vec, codes[cut[0] : cut[-1]], cut - cut[0])
    f = attend(sums[:, :HIDDEN] / np.maximum(sums[:, HIDDEN:], 1), figures, first, m)
    return sigmoid(f["logit"].astype(np.float64) / m["heat"])


def score(docs: DataFrame, model: dict, *, carry: list[str], text_col: str = "text") -> DataFrame:
    """(doc struct<carry...>, score), a row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(text_col).alias("text"))
    schema = T.StructType([picked.schema["doc"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for t in batches_by_bytes(batches, "text", CHUNK):
            yield from pa.table({"doc": array_of(t, "doc"), "score": pa.array(score_texts(array_of(t, "text"), shared.value))}).to_batches()

    return picked.mapInArrow(run, schema)


def op13_mil_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    docs = docs.withColumn("held_out", F.crc32(id_text("doc_id").cast("binary")) % 3 == 1)
    return score(docs, model, carry=["doc_id", "held_out"]).select("doc.doc_id", "doc.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
