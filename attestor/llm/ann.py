"""Nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph; the graph is cut into balanced parts; a small network learns which part a vector
belongs to, and routes: every row goes to its most probable part, a query to as many of its most probable parts as hold
nearly all of the probability. Candidates of those parts are reranked by exact inner products in double precision.

There are LEAST_PARTS parts or more wherever rows suffice. A network tells FAN parts apart at most: where there are rows for
more, every part with too many rows is split in the same way by a sample, a graph and a network of its own, level by level,
so the rows that a query meets don't grow with the table.

Only the index is fitted on samples (SAMPLE rows of each part that is split, chosen by hash); every row is indexed. Parts of
any size are dealt in blocks of candidates and blocks of queries, so a vector repeated a million times is no hot task, and
the best of all blocks are merged. There is no cap on candidates.

Defined results: vectors null, empty, zero, with null or non-finite components or of another length than most take no part;
nor do null ids; rows with one id count once, with the least of their vectors; ties go to the smaller id; an empty table
gives an empty result.
"""

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import array_of, batches_by_bytes, table, work_dir, written

#: Bound of the sample that the partition is learned from.
SAMPLE = 8192
K, EVERY = 20, 20
#: Rows of a part, aimed at; parts that a network tells apart at most (what SAMPLE rows can teach), and at least.
PART_ROWS, FAN, LEAST_PARTS = 4096, 64, 8
GRAPH_K, SLACK, PASSES = 16, 1.1, 12
HIDDEN, EPOCHS, BATCH = 128, 60, 256
#: A query goes to its most probable parts until they hold this share of the probability.
REACH = 0.97
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k nearest other rows of each row by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Parts of nearly equal size that cut few edges: regions grown over the graph, then single moves that save edges."""
    n = len(near)
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    begin, to = np.searchsorted(a[order], np.arange(n + 1)), b[order]
    rng = np.random.default_rng(seed)
    part, most = np.full(n, -1), int(np.ceil(SLACK * n / parts))
    size, goal = np.zeros(parts, np.int64), -(-n // parts)
    seeds = iter(rng.permutation(n))
    for p in range(parts):
        queue: list[int] = []
        while size[p] < goal:
            if not queue:
                seed_ = next((s for s in seeds if part[s] < 0), None)
                if seed_ is None:
                    break
                queue, part[seed_] = [int(seed_)], p
                size[p] += 1
                continue
            x, queue = queue[0], queue[1:]
            for y in to[begin[x] : begin[x + 1]].tolist():
                if part[y] < 0 and size[p] < goal:
                    part[y] = p
                    size[p] += 1
                    queue.append(y)
    for x in np.flatnonzero(part < 0):
        part[x] = int(size.argmin())
        size[part[x]] += 1
    for _ in range(PASSES):
        moved = 0
        for x in rng.permutation(n):
            votes = np.bincount(part[to[begin[x] : begin[x + 1]]], minlength=parts)
            votes[(size >= most) & (np.arange(parts) != part[x])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[x]]:
                size[part[x]] -= 1
                size[best] += 1
                part[x] = best
                moved += 1
        if moved < n // 500:
            break
    return part


def train(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, seed: int = 5) -> dict:
    """A network of one hidden layer; its goal for a vector is the share of each part among the vector and its neighbours."""
    rng = np.random.default_rng(seed)
    scale = float(1 / max(np.sqrt((x**2).mean()), 1e-12))
    goal = np.zeros((len(x), parts), np.float32)
    np.add.at(goal, (np.arange(len(x)), part), 4)
    for j in range(near.shape[1]):
        np.add.at(goal, (np.arange(len(x)), part[near[:, j]]), 1)
    goal /= goal.sum(1, keepdims=True)
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    w = [v.astype(np.float32) for v in w]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (x * scale).astype(np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            r = order[at : at + BATCH]
            h = np.maximum(z[r] @ w[0] + w[1], 0)
            p = _softmax(h @ w[2] + w[3])
            d = (p - goal[r]) / len(r)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate([z[r].T @ dh, dh.sum(0), h.T @ d, d.sum(0)]):
                g = g + 1e-5 * w[i]
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                w[i] -= 2e-3 * (1 - epoch / EPOCHS) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "scale": scale, "parts": parts}


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def route(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of each part."""
    if model["parts"] == 1:
        return np.ones((len(x), 1), np.float32)
    w = model["w"]
    return _softmax(np.maximum((x * model["scale"]).astype(np.float32) @ w[0] + w[1], 0) @ w[2] + w[3])


def learn(sample: np.ndarray, parts: int) -> dict:
    parts = min(parts, len(sample) // 8)
    if parts < 2:
        return {"parts": 1}
    near = neighbour_graph(sample)
    return train(sample, near, balanced_parts(near, parts), parts)


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.flatten())
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    fine = f"size(`{vec_col}`) > 0 AND forall(`{vec_col}`, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(`{vec_col}`, x -> x != 0)"
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine)
    return rows.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vec_col).alias("vec"))


def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """(query, candidate, score) rows of the k best candidates of each query, ties to smaller ids.

    A matrix product finds who can be among the best; their scores are then summed row by row, the same way for all.
    """
    q64, c64 = q.astype(np.float64), c.astype(np.float64)
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), 128):
        s = q64[at : at + 128] @ c64.T
        s[q_ids[at : at + 128, None] == c_ids[None, :]] = -np.inf
        n = min(k, s.shape[1])
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        for i in range(len(s)):
            hit = np.flatnonzero((s[i] >= least[i] - 1e-9 * max(1.0, abs(least[i]))) & (s[i] > -np.inf))
            exact = (c64[hit] * q64[at + i]).sum(1)
            order = np.lexsort((c_ids[hit], -exact))[:k]
            out_q.append(np.full(len(order), q_ids[at + i]))
            out_c.append(c_ids[hit][order])
            out_s.append(exact[order])
    return tuple(np.concatenate(o) if o else np.zeros(0, t) for o, t in ((out_q, np.int64), (out_c, np.int64), (out_s, np.float64)))


def _block(n, salt: int = 1):
    """A block of a row among so many rows."""
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")


def _spread(n):
    return F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))


def _probed(p: np.ndarray, fill: np.ndarray, reach: float, k: int) -> np.ndarray:
    """(row, part) pairs: parts by falling probability, as long as those before lack probability or rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    mass, rows = np.cumsum(np.take_along_axis(p, order, 1), 1), np.cumsum(fill[order], 1)
    go = np.concatenate([np.ones((len(p), 1), bool), (mass[:, :-1] < reach) | (rows[:, :-1] < k + 1)], 1)
    q, j = np.nonzero(go)
    return q, order[q, j]


def _counted(rows: DataFrame, path: str) -> DataFrame:
    return written(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), path)


def _descend(placed: DataFrame, asked: DataFrame, sizes: DataFrame, at: str, level: int, k: int, reach: float, sample: int, part_rows: int):
    """(placed, asked, sizes) one level deeper: parts with too many rows are split by a network of their own."""
    kind = placed.schema["vec"].dataType.simpleString()
    big = written(sizes.filter(F.col("n") > 4 * part_rows), f"{at}/big{level}")
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    drawn = placed.join(big, "part").filter(F.pmod(F.xxhash64("vec_id", F.lit(level)), F.lit(1 << 24)) < F.lit(1 << 24) * share).select("part", "n", "vec_id", "vec")

    def learn_one(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        fan = int(min(FAN, max(2, round(t.column("n")[0].as_py() / part_rows))))
        return pa.table({"part": t.column("part").slice(0, 1), "model": pa.array([pickle.dumps(learn(matrix(t.column("vec").combine_chunks()).astype(np.float32), fan))], pa.binary())})

    models = written(drawn.groupBy("part").applyInArrow(learn_one, "part long, model binary"), f"{at}/models{level}")
    blocks = lambda per: F.ceil(F.col("n") / per)

    def assign(rows: pa.Table, own: pa.Table) -> pa.Table:
        p = route(pickle.loads(own.column("model")[0].as_py()), matrix(rows.column("vec").combine_chunks())) if rows.num_rows else np.zeros((0, 1))
        return pa.table({"vec_id": rows.column("vec_id"), "vec": rows.column("vec"), "part": pa.array(np.asarray(rows.column("part")) * FAN + p.argmax(1), pa.int64())})

    dealt = placed.join(big, "part").select("part", _block(blocks(BLOCK_ROWS)).alias("b"), "vec_id", "vec")
    own = models.join(big, "part").select("part", _spread(blocks(BLOCK_ROWS)).alias("b"), "model")
    split = dealt.groupBy("part", "b").cogroup(own.groupBy("part", "b")).applyInArrow(assign, f"vec_id long, vec {kind}, part long")
    rest = lambda rows: rows.join(big, "part", "left_anti").select("vec_id", "vec", (F.col("part") * FAN).alias("part"))
    placed = written(split.unionByName(rest(placed)), f"{at}/placed{level}")
    below = _counted(placed, f"{at}/sizes{level}")
    fills = below.groupBy((F.col("part") / FAN).cast("long").alias("part")).agg(F.collect_list(F.struct((F.col("part") % FAN).alias("child"), "n")).alias("fill"))

    def probe(rows: pa.Table, own: pa.Table) -> pa.Table:
        model = pickle.loads(own.column("model")[0].as_py())
        fill = np.zeros(model["parts"], np.int64)
        for f in own.column("fill")[0].as_py():
            fill[f["child"]] = f["n"]
        q, child = _probed(route(model, matrix(rows.column("vec").combine_chunks())), fill, reach, k) if rows.num_rows else (np.zeros(0, np.int64),) * 2
        picked = rows.take(pa.array(q))
        return pa.table({"vec_id": picked.column("vec_id"), "vec": picked.column("vec"), "part": pa.array(np.asarray(picked.column("part")) * FAN + child, pa.int64())})

    wanted = _counted(asked.join(big, "part", "left_semi"), f"{at}/wanted{level}")
    dealt = asked.join(wanted, "part").select("part", _block(blocks(BLOCK_QUERIES)).alias("b"), "vec_id", "vec")
    own = models.join(fills, "part").join(wanted, "part").select("part", _spread(blocks(BLOCK_QUERIES)).alias("b"), "model", "fill")
    split = dealt.groupBy("part", "b").cogroup(own.groupBy("part", "b")).applyInArrow(probe, f"vec_id long, vec {kind}, part long")
    return placed, written(split.unionByName(rest(asked)), f"{at}/asked{level}"), below


def search(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, reach: float = REACH, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by `every`."""
    spark, at = rows.sparkSession, work_dir(rows.sparkSession)
    vectors = written(usable(rows, id_col, vec_col), f"{at}/vectors")
    dims = vectors.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim, total = (dims[0]["d"], dims[0]["n"]) if dims else (1, 0)
    vectors = vectors.filter(F.size("vec") == dim)
    kind = vectors.schema["vec"].dataType.simpleString()
    fan = int(min(FAN, max(LEAST_PARTS, round(total / part_rows))))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 24)) < min(1 << 24, int((1 << 24) * sample / max(total, 1)))).orderBy(F.xxhash64("vec_id")).select("vec").limit(2 * sample).toArrow()
    model = learn(matrix(chosen.column("vec").combine_chunks()).astype(np.float32), fan)
    shared = spark.sparkContext.broadcast(model)

    def assign(batches):
        for t in batches_by_bytes(batches, "vec", 8 << 20):
            p = route(shared.value, matrix(array_of(t, "vec")))
            probs = pa.array([r if i % every == 0 else None for i, r in zip(np.asarray(t.column("vec_id")).tolist(), p)], pa.list_(pa.float32()))
            yield from t.append_column("part", pa.array(p.argmax(1), pa.int64())).append_column("probs", probs).to_batches()

    first = written(vectors.mapInArrow(assign, f"vec_id long, vec {kind}, part long, probs array<float>"), f"{at}/placed")
    placed = first.select("vec_id", "vec", "part")
    sizes = _counted(placed, f"{at}/sizes")
    filled = np.zeros(model["parts"], np.int64)
    for r in sizes.collect():  # FAN rows at most
        filled[r["part"]] = r["n"]

    def probes(batches):
        for t in batches_by_bytes(batches, "vec", 8 << 20):
            q, part = _probed(matrix(array_of(t, "probs")), filled, reach, k)
            yield from t.select(["vec_id", "vec"]).take(pa.array(q)).append_column("part", pa.array(part, pa.int64())).to_batches()

    asked = written(first.filter("probs IS NOT NULL").select("vec_id", "vec", "probs").mapInArrow(probes, f"vec_id long, vec {kind}, part long"), f"{at}/asked")
    levels = math.ceil(math.log(max(1.0, total / (FAN * part_rows)), FAN))
    for level in range(1, levels + 1):
        placed, asked, sizes = _descend(placed, asked, sizes, at, level, k, reach, sample, part_rows)

    wanted = _counted(asked, f"{at}/wanted").withColumnRenamed("n", "m")
    plan = written(sizes.join(wanted, "part").select("part", F.ceil(F.col("n") / BLOCK_ROWS).alias("cbs"), F.ceil(F.col("m") / BLOCK_QUERIES).alias("qbs")), f"{at}/plan")
    cand = placed.join(plan, "part").select("part", _block(F.col("cbs")).alias("cb"), _spread(F.col("qbs")).alias("qb"), "vec_id", "vec")
    ask = asked.join(plan, "part").select("part", _spread(F.col("cbs")).alias("cb"), _block(F.col("qbs")).alias("qb"), "vec_id", "vec")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, c, s = best_of(np.asarray(left.column("vec_id")), matrix(left.column("vec").combine_chunks()), np.asarray(right.column("vec_id")), matrix(right.column("vec").combine_chunks()), k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    found = ask.groupBy("part", "cb", "qb").cogroup(cand.groupBy("part", "cb", "qb")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_learned_partitions(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
