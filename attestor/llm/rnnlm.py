"""A gated recurrent language model with class-factored output, in numpy.

Counts come from the whole corpus: every document is dictionary-encoded once (codes of its words, and a list of the
distinct words of each chunk of documents); the lists are summed to exact counts of all training tokens, and joined back.

The model knows the commonest words, in classes of equal size, and puts every other word into a class by its spelling;
its output is P(class | state) * P(symbol | class, state) over symbols in classes of equal size, known words and spellings
alike; a word outside the known ones has its spelling's probability times its smoothed count among all words so spelt, and
each word not seen in training gets the whole reserve of its spelling. The network is a gated recurrent unit trained by
truncated backpropagation on all training documents: replicas train on groups of documents, chosen and ordered by a hash of
id and content (and of their number among repeated rows), and their weights are averaged after each round. Scoring carries the state through a whole document and
resets it at the next; no text is cut.

Defined results: null and empty texts are the end token alone; a null id counts as the text '' for the split; without
training documents the base is log10(0.1 / 0.1) = 0 for every token and so is the score; repeated rows are scored each.
"""


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import array_of, batches_by_bytes, id_text, release, split_words, table, work_dir, written

END = "\n"  # no word holds a line feed
#: Words the network knows one by one, END included; spellings for all other words; symbols of a class.
HEAD, SPELLINGS, PER = 1024, 96, 40
SYMBOLS, CLASSES = HEAD + SPELLINGS, (HEAD + SPELLINGS) // PER
HIDDEN, WINDOW, LANES = 32, 16, 256
#: Tokens a replica sees in all its rounds, aimed at; replicas grow with the corpus.
REPLICA_TOKENS, ROUNDS, RATE = 8_000_000, 3, 4e-3
ALPHA = 0.1
#: Rows of a symbol that are added up before their sums are.
RUN = 24
#: Weights that one task adds up at a time; copies of a row that one task makes.
FAN_IN, COPIES = 16, 4096


def spelling(word: str) -> int:
    """A class by last character and by the first letter beyond ASCII or else the first two characters."""
    last = word[-1]
    kind = 0 if last.isalpha() else 1 if last == "." else 2 if last == "," else 3
    if word.isascii():
        return kind * 24 + 8 + (ord(word[0]) * 31 + ord(word[1:2] or "\0")) % 16
    return kind * 24 + ord(next(c for c in word if c > "\x7f")) % 8


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds. Documents: (chunk, doc_id, held_out, codes). Words: (chunk, code, token, times in training)."""
    import zstandard

    schema = "kind int, chunk long, doc_id long, held_out boolean, codes binary, code int, token string, times long"
    held_out = F.crc32(id_text(id_col).cast("binary")) % 10 == 0

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        squeeze = zstandard.ZstdCompressor(level=1)
        for t in batches_by_bytes(batches, "text"):
            chunk, k = (task << 20) + k, k + 1
            codes, offsets, words = split_words(array_of(t, "text"), lower=True)
            held = np.asarray(array_of(t, "held_out").to_numpy(zero_copy_only=False), bool)
            n, m = len(held), len(words)
            times = np.bincount(codes[np.repeat(~held, np.diff(offsets))], minlength=m)
            packed = [squeeze.compress(codes[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            none = lambda size, kind: pa.nulls(size, kind)
            for at in range(0, n, 2048):
                to = min(n, at + 2048)
                s = to - at
                yield pa.RecordBatch.from_arrays([pa.array([0] * s, pa.int32()), pa.array([chunk] * s, pa.int64()), array_of(t, "doc_id").slice(at, s), pa.array(held[at:to]), pa.array(packed[at:to], pa.binary()), none(s, pa.int32()), none(s, pa.string()), none(s, pa.int64())], names)
            listed = pa.concat_arrays([words, pa.array([END], words.type)])
            times = np.append(times, int((~held).sum()))
            for at in range(0, m + 1, 1 << 16):
                to = min(m + 1, at + (1 << 16))
                s = to - at
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(s), pa.int32()), pa.array([chunk] * s, pa.int64()), none(s, pa.int64()), none(s, pa.bool_()), none(s, pa.binary()), pa.array(np.arange(at, to), pa.int32()), listed.slice(at, s).cast(pa.string()), pa.array(times[at:to], pa.int64())], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def spelt(counted: DataFrame) -> DataFrame:
    """(token, c, spelling) of rows (token, c): each distinct word's spelling is looked at once, not once a chunk."""

    def run(batches):
        for t in batches:
            kinds = [0 if w == END else spelling(w) for w in t.column("token").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("token"), t.column("c"), pa.array(kinds, pa.int32())], ["token", "c", "spelling"])

    return counted.select("token", "c").mapInArrow(run, "token string, c long, spelling int")


# ---- the network


def start(counts: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights that give the symbols' unigram distribution whatever the state.

    x: what a symbol adds to the candidate and to the gate; u: what the state adds to the gate and to the candidate, apart, so
    that each part lies in one piece. c, w: logits of classes and of each class's symbols, the bias in the last row.
    """
    rng = np.random.default_rng(seed)
    h = HIDDEN
    per = counts.reshape(CLASSES, PER) + ALPHA
    x, u = rng.normal(0, 0.3, (SYMBOLS, 2, h)), rng.normal(0, 1 / np.sqrt(h), (h, 2, h))
    c, w = np.zeros((h + 1, CLASSES)), np.zeros((CLASSES, h + 1, PER))
    c[h], w[:, h] = np.log(per.sum(1) / per.sum()), np.log(per / per.sum(1, keepdims=True))
    return {k: np.ascontiguousarray(v, np.float32) for k, v in {"x": x[:, ::-1].transpose(1, 0, 2), "u": u.transpose(1, 0, 2), "c": c, "w": w}.items()}


def step(p: dict, h: np.ndarray, x: np.ndarray, slopes: np.ndarray | None = None):
    """One step of a unit with one gate, which both forgets and resets: (new state, gate).

    gate = (1 + a / (1 + |a|)) / 2, a sigmoid without exponentials; new = h + gate * (tanh(in + gate * own) - h).
    slopes, if given, gets the derivatives of the new state by the candidate's input, the gate's input, and the candidate's own.
    """
    (c, f), (a, own) = p["x"].take(x, axis=1), h @ p["u"]
    f += a
    low = np.abs(f, out=a)
    low += 1
    np.divide(0.5, low, out=low)
    f *= low
    f += 0.5
    new = f * own
    c += new
    np.tanh(c, out=c)
    gap = c - h
    np.multiply(f, gap, out=new)
    new += h
    if slopes is not None:
        by_input, by_gate, by_own = slopes
        c *= c
        np.subtract(1, c, out=c)
        np.multiply(c, f, out=by_input)
        np.multiply(by_input, f, out=by_own)
        own *= by_input
        own += gap
        low *= low
        low *= 2
        np.multiply(own, low, out=by_gate)
    return new, f


def _bound(p: dict) -> float:
    """No logit is further from 0, as no component of a state exceeds 1."""
    return float(max(np.abs(p[k]).sum(-2).max() for k in "cw"))


def by_class(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of symbols' classes, and where each class begins in it."""
    k = np.minimum(y // PER, CLASSES).astype(np.uint8)
    return np.argsort(k, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(k, minlength=CLASSES)[:CLASSES])])


def _slices(edge: np.ndarray) -> list[tuple[int, slice]]:
    """The classes that occur, each with its rows."""
    edge = edge.tolist()
    return [(q, slice(a, b)) for q, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]


def joined(p: dict) -> np.ndarray:
    """For each class the weights of all classes and of its own symbols side by side, so that one product gives both logits."""
    both = np.empty((CLASSES, HIDDEN + 1, CLASSES + PER), np.float32)
    both[:, :, :CLASSES], both[:, :, CLASSES:] = p["c"], p["w"]
    return both


def exp_logits(both: np.ndarray, h: np.ndarray, parts: list[tuple[int, slice]], most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exp of the logits of classes and of the symbols of each row's class, sums of both); rows in order of class, 1 in their last column.

    The largest of each row is taken off only where their bound, most, could overflow.
    """
    s = np.empty((len(h), CLASSES + PER), np.float32)
    for q, i in parts:  # each while it is at hand in the processor's cache
        own = s[i]
        np.dot(h[i], both[q], out=own)
        if most > 40:
            own[:, :CLASSES] -= own[:, :CLASSES].max(1, keepdims=True)
            own[:, CLASSES:] -= own[:, CLASSES:].max(1, keepdims=True)
        np.exp(own, out=own)
    return s, s[:, :CLASSES] @ np.ones(CLASSES, np.float32), s[:, CLASSES:] @ np.ones(PER, np.float32)


def log_probs(p: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of P(class | h) P(symbol | class, h)."""
    return _log_probs(joined(p), _bound(p), np.column_stack([h, np.ones(len(h), np.float32)]), y)


def _log_probs(both: np.ndarray, most: float, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    rows, edge = by_class(y)
    y, i = y[rows], np.arange(len(y))
    s, of_classes, of_symbols = exp_logits(both, h.take(rows, axis=0), _slices(edge), most)
    found = s[i, y // PER] / of_classes
    found *= s[i, CLASSES + y % PER] / of_symbols
    out = np.empty(len(y))
    out[rows] = np.log(found)
    return out


def sums_of_runs(rows: np.ndarray, at: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run the sum of rows[:, at[start : start + count]].

    The k-th rows of all runs are added at once, and runs above RUN rows are first cut into pieces.
    """
    if counts.max() > RUN:
        pieces = -(-counts // RUN)
        first = np.cumsum(pieces) - pieces
        within = RUN * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        sums = sums_of_runs(rows, at, np.repeat(starts, pieces) + within, np.minimum(RUN, np.repeat(counts, pieces) - within))
        return sums_of_runs(sums, np.arange(sums.shape[1]), first, pieces)
    by = np.argsort(-counts, kind="stable")
    starts = starts[by]
    left = len(counts) - np.cumsum(np.bincount(counts, minlength=RUN + 1))  # runs of more than k rows
    total = rows.take(at[starts], axis=1)
    for k in range(1, int(counts.max())):
        n = left[k]
        total[:, :n] += rows.take(at[starts[:n] + k], axis=1)
    out = np.empty_like(total)
    out[:, by] = total
    return out


PAD = 0xFFFF


def streams(docs: list[np.ndarray], lanes: int, seed: int | None = None):
    """Documents dealt to lanes, longest first to the shortest lane: (symbols padded with PAD, starts, documents of each lane), lanes longest first.

    With a seed, the documents of a lane come in random order.
    """
    import heapq

    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    heap = [(0, i) for i in range(min(lanes, max(1, len(docs))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for i in order:
        size, lane = heapq.heappop(heap)
        dealt[lane].append(i)
        heapq.heappush(heap, (size + len(docs[i]), lane))
    dealt.sort(key=lambda d: -sum(len(docs[i]) for i in d))
    if seed is not None:
        rng = np.random.default_rng(seed)
        dealt = [[d[i] for i in rng.permutation(len(d))] for d in dealt]
    length = max((sum(len(docs[i]) for i in d) for d in dealt), default=0)
    y, first = np.full((length, len(dealt)), PAD, np.uint16), np.zeros((length, len(dealt)), bool)
    for lane, d in enumerate(dealt):
        at = 0
        for i in d:
            y[at : at + len(docs[i]), lane], first[at, lane] = docs[i], True
            at += len(docs[i])
    return y, first, dealt


def inputs(y: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The symbol before each one; the end token before a document's first."""
    x = np.empty_like(y)
    x[0], x[1:] = end, y[:-1]
    x[first] = end
    return x


def score(p: dict, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each whole document, spelling classes' words left out."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    size, longest = sum(map(len, docs)), max(map(len, docs))
    y, first, dealt = streams(docs, int(np.clip(1.1 * size / max(longest, 1), 16, 1024)))
    x, lives, fresh = inputs(y, first, end), (y != PAD).sum(1), first.any(1)
    h = np.zeros((y.shape[1], HIDDEN), np.float32)
    whose = [iter(d) for d in dealt]
    now = np.zeros(y.shape[1], np.int64)
    both, most = joined(p), _bound(p)
    states, targets, owners, held = np.ones(((1 << 12) + y.shape[1], HIDDEN + 1), np.float32), [], [], 0
    for t in range(len(y)):
        n = lives[t]
        h = h[:n]
        if fresh[t]:
            h[first[t, :n]] = 0
            now = now.copy()
            for lane in np.flatnonzero(first[t]).tolist():
                now[lane] = next(whose[lane])
        h, _ = step(p, h, x[t, :n])
        states[held : held + n, :HIDDEN] = h
        targets.append(y[t, :n])
        owners.append(now[:n])
        held += n
        if held >= 1 << 12 or t == len(y) - 1:
            total += np.bincount(np.concatenate(owners), weights=_log_probs(both, most, states[:held], np.concatenate(targets)), minlength=len(docs))
            targets, owners, held = [], [], 0
    return total


def train(p: dict, docs: list[np.ndarray], end: int, rate: float = RATE) -> dict:
    """One pass of truncated backpropagation; the state runs on from window to window."""
    if not docs:
        return {k: a.copy() for k, a in p.items()}
    # the weights of all but x in one piece, updated at once
    dense = [k for k in sorted(p) if k != "x"]
    cuts = np.cumsum([p[k].size for k in dense])[:-1]
    named = lambda flat: {k: part.reshape(p[k].shape) for k, part in zip(dense, np.split(flat, cuts))}
    weights = np.concatenate([p[k].ravel() for k in dense])
    grads, m, v = np.empty_like(weights), np.zeros_like(weights), np.zeros_like(weights)
    seen, count = np.zeros_like(p["x"]), 0
    p, g = {"x": p["x"].copy(), **named(weights)}, named(grads)
    y, first, _ = streams(docs, LANES, seed=len(docs))
    x = inputs(y, first, end)
    n, width = HIDDEN, y.shape[1]
    steps, lives = -(-len(y) // WINDOW), (y != PAD).sum(1)
    x[x == PAD] = end
    bound = 0.0
    h = np.zeros((width, n), np.float32)
    by_class_grads = np.empty((CLASSES, n + 1, CLASSES + PER), np.float32)
    for at in range(0, len(y), WINDOW):
        span, live = min(WINDOW, len(y) - at), int(lives[at])
        begins = first[at : at + span, :live]
        fresh = begins.any(1)
        befores, states = np.empty((span, live, n), np.float32), np.empty((span, live, n + 1), np.float32)
        states[:, :, n] = 1
        slopes, gates, h = np.empty((3, span, live, n), np.float32), [], h[:live]
        for t in range(span):
            if fresh[t]:
                h[begins[t]] = 0
            befores[t] = h
            h, gate = step(p, h, x[at + t, :live], slopes[:, t])
            states[t, :, :n] = h
            gates.append(gate)
        goal = y[at : at + span, :live].ravel()
        rows, edge = by_class(goal)
        rows, parts = rows[: edge[CLASSES]], _slices(edge)  # what fills the lanes comes last
        yo, ho, share, i = goal[rows], states.reshape(-1, n + 1).take(rows, axis=0), np.float32(1 / len(rows)), np.arange(len(rows))
        if at % (64 * WINDOW) == 0:  # 64 small steps do not lift them to where exp overflows
            bound = _bound(p)
        both = joined(p)
        s, of_classes, of_symbols = exp_logits(both, ho, parts, bound)
        s[:, :CLASSES] *= (share / of_classes)[:, None]
        s[:, CLASSES:] *= (share / of_symbols)[:, None]
        i *= CLASSES + PER
        s.reshape(-1)[np.concatenate([i + yo // PER, i + CLASSES + yo % PER])] -= share
        out = np.zeros((len(rows) + 1, n), np.float32)  # the last for what fills the lanes
        if len(parts) < CLASSES:
            by_class_grads[:] = 0
        for q, of in parts:
            np.dot(ho[of].T, s[of], out=by_class_grads[q])
            np.dot(s[of], both[q, :n].T, out=out[of])
        np.sum(by_class_grads[:, :, :CLASSES], axis=0, out=g["c"])
        g["w"][:] = by_class_grads[:, :, CLASSES:]
        place = np.full(len(goal), len(rows))
        place[rows] = np.arange(len(rows))
        back, dh, turned = out.take(place, axis=0).reshape(span, live, n), np.zeros((live, n), np.float32), p["u"].transpose(0, 2, 1)
        for t in range(span - 1, -1, -1):
            dh += back[t]
            own = slopes[:, t]
            own *= dh  # now the derivatives of the loss
            gates[t] *= dh
            dh -= gates[t]
            dh += own[1] @ turned[0]
            dh += own[2] @ turned[1]
            if fresh[t]:
                dh[begins[t]] = 0
        for k in range(2):
            np.dot(befores.reshape(-1, n).T, slopes[1 + k].reshape(-1, n), out=g["u"][k])
        sym = x[at : at + span, :live].ravel()
        times = np.bincount(sym, minlength=SYMBOLS)
        used = np.flatnonzero(times)
        times = times[used]
        gx = sums_of_runs(slopes[:2].reshape(2, -1, n), np.argsort(sym, kind="stable"), np.cumsum(times) - times, times)
        count += 1
        lr = rate * (1 - 0.9 * (at / WINDOW) / steps)
        fix1, fix2 = 1 - 0.9**count, 1 - 0.99**count
        np.clip(grads, -1, 1, out=grads)
        m *= 0.9
        m += 0.1 * grads
        v *= 0.99
        grads *= grads
        grads *= 0.01
        v += grads
        move = np.sqrt(v)
        move *= 1 / np.sqrt(fix2)
        move += 1e-6
        np.divide(m, move, out=move)
        move *= lr / fix1
        weights -= move
        for own, squares, table in zip(gx, seen, p["x"]):  # rows are sparse: their rates fall with what they have seen
            total = squares.take(used, axis=0)
            total += own * own
            squares[used] = total
            np.sqrt(total, out=total)
            total += 1e-6
            np.divide(own, total, out=total)
            total *= 10 * lr
            table[used] = table.take(used, axis=0) - total
    return p


def pack_weights(p: dict) -> bytes:
    return b"".join(p[k].astype("<f4").tobytes() for k in sorted(p))


def unpack_weights(data: bytes, like: dict) -> dict:
    flat, out, at = np.frombuffer(data, "<f4"), {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _replica(shared, end: int, rate: float):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("h")), kind="stable")  # the same order however rows arrive
        ids = t.column("ids").to_pylist()
        parts = [np.frombuffer(ids[i], "<u2") for i in order.tolist()]
        size, weights = sum(map(len, parts)), train(shared.value, parts, end, rate)
        release()
        scaled = {key: a * np.float32(size) for key, a in weights.items()}
        return pa.table({"g": t.column("g").slice(0, 1), "size": pa.array([size], pa.int64()), "weights": pa.array([pack_weights(scaled)], pa.binary())})

    return run


def _add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    rows = t.column("weights").to_pylist()
    total = np.frombuffer(rows[0], "<f4").copy()
    for r in rows[1:]:
        total += np.frombuffer(r, "<f4")
    return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([sum(t.column("size").to_pylist())], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def summed(own: DataFrame, groups: int) -> DataFrame:
    """Sums of sizes and weights, in a tree: FAN_IN tables at most meet in a task, and FAN_IN rows at most are left. own: (g from 0 to groups - 1, size, weights)."""
    while groups > FAN_IN:
        own = own.groupBy(F.floor(F.col("g") / FAN_IN).cast("int").alias("part")).applyInArrow(_add, "g int, size long, weights binary")
        groups = -(-groups // FAN_IN)
    return own


def dealt(symbols: DataFrame, at: str) -> DataFrame:
    """(h, ids) with a hash of its own for each copy of a repeated row, so that copies spread over replicas and rounds like other rows.

    symbols: (h, ids), h being a hash of all that a row is. Copies are counted before they meet and dealt out in blocks.
    """
    repeated = written(symbols.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), f"{at}/repeated")
    counted = symbols.join(repeated, "h", "left_semi").groupBy("h", "ids").agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.select("h", "ids", "n", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")).alias("first")).repartition("h", "first")
    copies = blocks.select(F.explode(F.expr(f"sequence(first, least(first + {COPIES}, n) - 1)")).alias("copy"), "h", "ids").select(F.xxhash64("h", "copy").alias("h"), "ids")
    return symbols.join(repeated, "h", "left_anti").select("h", "ids").unionByName(written(copies, f"{at}/copies"))


def fit(symbols: DataFrame, p: dict, end: int, tokens: int, replica_tokens: int = REPLICA_TOKENS, rounds: int = ROUNDS) -> dict:
    """Rounds of local training and averaging. symbols: (h long, ids binary), written. The driver gets at most FAN_IN sums of weights."""
    spark = symbols.sparkSession
    groups = max(1, -(-tokens // replica_tokens))
    placed = symbols.withColumn("g", F.pmod(F.col("h"), F.lit(groups)).cast("int")).withColumn("round", F.pmod(F.shiftrightunsigned("h", 32), F.lit(rounds)).cast("int"))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(p)

        own = placed.filter(F.col("round") == k).select("g", "h", "ids").groupBy("g").applyInArrow(_replica(shared, end, RATE / (1 + k)), "g int, size long, weights binary")
        sums = summed(own, groups).collect()
        if sums:
            total, size = sum(np.frombuffer(bytes(r["weights"]), "<f4").astype(np.float64) for r in sums), sum(r["size"] for r in sums)
            p = unpack_weights((total / max(size, 1)).astype("<f4").tobytes(), p)
    return p


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", replica_tokens: int = REPLICA_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of whole texts."""
    spark = docs.sparkSession
    at = work_dir(spark)
    encode(docs, id_col=id_col, text_col=text_col).write.option("compression", "zstd").partitionBy("kind").parquet(f"{at}/encoded")
    schema = "chunk long, doc_id long, held_out boolean, codes binary, code int, token string, times long"
    coded = spark.read.schema(schema + ", kind int").parquet(f"{at}/encoded")
    texts, words = coded.filter("kind = 0").select("chunk", "doc_id", "held_out", "codes"), coded.filter("kind = 1").select("chunk", "code", "token", "times")

    vocabulary = written(spelt(words.groupBy("token").agg(F.sum("times").alias("c"))), f"{at}/vocabulary")
    stats = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(stats["n"]), int(stats["v"])
    top = [(r["token"], r["c"]) for r in vocabulary.filter(F.col("c") > 0).filter(F.col("token") != END).orderBy(F.desc("c"), "token").limit(HEAD - 1).collect()]
    ends = vocabulary.filter(F.col("token") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    top = sorted([*top, (END, int(ends))], key=lambda r: (-r[1], r[0]))
    head = {w: i for i, (w, _) in enumerate(top)}
    end = head[END]
    counts = np.zeros(SYMBOLS)
    counts[: len(top)] = [c for _, c in top]
    heads = spark.createDataFrame([(w, i) for w, i in head.items()], "token string, id int")
    marked = vocabulary.join(F.broadcast(heads), "token", "left")
    per = np.zeros((SPELLINGS, 2))
    for r in marked.filter("id IS NULL").groupBy("spelling").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).collect():
        per[r["spelling"]] = r["n"], r["v"]
    ids = F.coalesce(F.col("id"), F.col("spelling") + HEAD)
    once = marked.select("token", "c", ids.alias("id")).hint("shuffle_hash")  # a row for each word, so that no partition of it is large and neither side is sorted
    known = written(words.select("chunk", "code", "token").join(once, "token").select("chunk", "code", "c", "id"), f"{at}/known")

    base_log = lambda c: np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))

    def symbols_of(t: pa.Table, w: pa.Table) -> pa.Table:
        """A chunk's documents in the corpus's own symbols, with all that counts alone tell of them."""
        import zstandard

        code = np.asarray(w.column("code"))
        c, s = np.zeros(len(code), np.int64), np.zeros(len(code), np.int32)
        c[code], s[code] = np.asarray(w.column("c")), np.asarray(w.column("id"))
        per_class = per[np.maximum(s - HEAD, 0)]
        inside = np.where(s < HEAD, 0.0, np.log10((c + ALPHA) / (per_class[:, 0] + ALPHA * (per_class[:, 1] + 1))))
        base, known_, s = base_log(c), (c > 0).astype(np.int64), s.astype("<u2")
        undo, last = zstandard.ZstdDecompressor(), np.array([len(code) - 1], "<u4")
        rows = []
        for packed in t.column("codes").to_pylist():
            own = np.concatenate([np.frombuffer(undo.decompress(packed), "<u4"), last])
            rows.append((len(own), int(known_[own].sum()), float(base[own].sum()), float(inside[own].sum()), s[own].tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
        made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else [()] * 5, kinds)]
        release()
        return pa.table([t.column("doc_id"), t.column("held_out"), *made], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "ids"])

    own = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, ids binary"
    symbols = written(texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(symbols_of, own).withColumn("h", F.xxhash64("doc_id", "ids")), f"{at}/symbols")
    counts[HEAD:] = per[:, 0]
    weights = start(counts)
    if n:
        training = symbols.filter(~F.col("held_out")).select("h", "ids")
        weights = fit(dealt(training, at), weights, end, n, replica_tokens=replica_tokens)
    shared, symbols = spark.sparkContext.broadcast(weights), symbols.drop("h")

    def score_rows(batches):
        for t in batches_by_bytes(batches, "ids", 6 << 20):
            ids = [np.frombuffer(b, "<u2") for b in t.column("ids").to_pylist()]
            found = (score(shared.value, ids, end) / np.log(10) + np.asarray(t.column("inside"))) if n else np.zeros(len(ids))
            release()
            out = t.select(["doc_id", "held_out", "n_tokens", "n_known"]).append_column("train_tokens", pa.array([n] * len(ids), pa.int64()))
            yield from out.append_column("base_score", t.column("base_score")).append_column("score", pa.array(found, pa.float64())).to_batches()

    return symbols.mapInArrow(score_rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
