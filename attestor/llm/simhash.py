"""SimHash near-duplicates by segment bit counts and a grid range-join.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints: a lower bound; in unary code (0, 1, 11) it is the bit count of a XOR.
The grid: segments fall into `most` + 2 groups or more. Of any two points within Manhattan distance `most`, all but `most`
groups agree, so cells have width 0 in each choice of that many groups; along the norm (the sum of all counts) cells have
width `most` + 1, and every point also visits the next one, so that points up to `most` apart meet. The more fingerprints
there are, the more groups, so cells stay small; no pair is lost at any number. Inside a cell points are sorted by norm and
swept: only those in the range of `most` are compared, first by the Manhattan bound, then by the exact Hamming distance.
A cell gives a link per fingerprint to its component's first one, never all pairs. Links join to components by hooking and
pointer jumping over written tables.

Equal fingerprints are folded first, so any number of copies is one entry.

Defined results: null, empty and wordless texts have fingerprint 0, linked like any other; fewer words than a shingle are
one shingle; component_id is the least non-null id (null if all are); repeated rows stay; an empty table stays empty.
"""

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import array_of, batches_by_bytes, table, work_dir, written

SEED, SHINGLE, DISTANCE = 42, 4, 4
SEGMENTS = 32
#: Fingerprints that chance should bring into a cell at most: beyond it there are more groups, up to MOST_CELLS cells each.
CELL_ROWS, MOST_CELLS = 8, 2000
SMALL_CELL, LEAST_ROWS = 64, 1 << 18
#: Rows of one root are dealt over so many tasks.
SALTS = 8


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """8 bytes, the highest bit first."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z and \\x20 \\x09-\\x0D only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_digest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):
        got = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step])]), np.uint8)
        ones += np.unpackbits(got.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of whole texts."""

    def run(batches):
        for t in batches_by_bytes(batches, "text"):
            texts = array_of(t, "text").cast(pa.large_binary()).to_pylist()
            fp = np.frombuffer(b"".join(fingerprint(x, shingle) for x in texts), ">i8").astype(np.int64)
            yield from pa.table({"doc_id": array_of(t, "doc_id"), "fp": pa.array(fp)}).to_batches()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def unary(fp: np.ndarray) -> np.ndarray:
    """Bit counts of two-bit segments in unary code."""
    low = np.uint64(0x5555555555555555)
    one, two = (fp | (fp >> np.uint64(1))) & low, (fp & (fp >> np.uint64(1))) & low
    return one | (two << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are within the distance: the Manhattan bound first, the exact distance for what it leaves."""
    ok = np.bitwise_count(ua ^ ub) <= most
    left = np.flatnonzero(ok)
    ok[left] = np.bitwise_count(a[left] ^ b[left] if len(b) == len(a) else a[left] ^ b) <= most
    return ok


def cell_links(cell: np.ndarray, fp: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal cells, each sorted by norm: (row, row of its component's first), at most one a row."""
    n, u, norm = len(fp), unary(fp), np.bitwise_count(fp).astype(np.int16)
    label = np.arange(n)
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, n))
    small = np.repeat(size <= SMALL_CELL, size)
    end = np.repeat(begin + size, size)
    a_all, b_all = [], []
    live = np.flatnonzero(small)
    for d in range(1, SMALL_CELL):
        live = live[live + d < end[live]]
        live = live[norm[live + d] - norm[live] <= most]  # sorted by norm: who is out of range now stays so
        if not len(live):
            break
        ok = near(fp[live], fp[live + d], u[live], u[live + d], most)
        a_all.append(live[ok])
        b_all.append(live[ok] + d)
    if a_all:
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
    for at, k in zip(begin[size > SMALL_CELL], size[size > SMALL_CELL]):
        rest = np.arange(at, at + k)  # not reached yet
        while len(rest):
            seed, rest = rest[0], rest[1:]
            todo = [seed]
            while todo and len(rest):
                x = todo.pop()
                lo, hi = np.searchsorted(norm[rest], [norm[x] - most, norm[x] + most + 1])
                part = rest[lo:hi]
                ok = near(fp[part], fp[x : x + 1], u[part], u[x : x + 1], most)
                if ok.any():
                    found = part[ok]
                    label[found] = seed
                    todo += found.tolist()
                    rest = np.concatenate([rest[:lo], part[~ok], rest[hi:]])
    row = np.flatnonzero(label != np.arange(n))
    return row, label[row]


def groups_for(fingerprints_: int, most: int = DISTANCE) -> int:
    """How many groups the segments fall into: a segment's count carries 1.5 bits, all groups but `most` make a cell."""
    g = most + 2
    while comb(g + 1, most) <= MOST_CELLS and g < SEGMENTS and fingerprints_ > CELL_ROWS * 2 ** (1.5 * SEGMENTS * (g - most) / g):
        g += 1
    return g


def cell_masks(groups: int, most: int = DISTANCE) -> list[int]:
    """Bits of each choice of groups that agree."""
    edge = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    bits = [sum(3 << (2 * s) for s in range(edge[g], edge[g + 1])) for g in range(groups)]
    return [sum(bits[g] for g in chosen) for chosen in combinations(range(groups), groups - most)]


def links(distinct: DataFrame, most: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(a, b): fingerprints that hang together, enough to join all that are within the distance. distinct has fp; it is read twice."""
    spark = distinct.sparkSession
    groups = groups or groups_for(distinct.count(), most)
    if not most + 2 <= groups <= SEGMENTS:
        raise ValueError(f"the grid needs {most + 2} to {SEGMENTS} groups for {most} differences, not {groups}")
    masks = [m - (1 << 64) if m >> 63 else m for m in cell_masks(groups, most)]
    low = 0x5555555555555555
    one = f"((fp | shiftrightunsigned(fp, 1)) & {low}L)"
    two = f"((fp & shiftrightunsigned(fp, 1)) & {low}L)"
    keyed = distinct.select("fp", F.bit_count("fp").cast("int").alias("norm"), F.expr(f"{one} | shiftleft({two}, 1)").alias("u"))
    cells = keyed.select("fp", "norm", F.expr("posexplode(array(" + ", ".join(f"u & {m}L" if m != -(1 << 63) else "u & shiftleft(1L, 63)" for m in masks) + "))").alias("choice", "cell"))
    cells = cells.select("choice", "cell", F.expr(f"explode(array(int(norm div {most + 1}), int(norm div {most + 1} + 1)))").alias("band"), "norm", "fp")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cells = cells.repartition(parts, "choice", "cell", "band").sortWithinPartitions("choice", "cell", "band", "norm", "fp")

    def solve(held):
        choice, cell, band, fp = (np.concatenate([h[i] for h in held]) for i in range(4))
        new = (choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1]) | (band[1:] != band[:-1])
        edges = np.flatnonzero(new) + 1
        return (choice, cell, band, fp), np.cumsum(np.concatenate([[0], new])), edges

    def run(batches):
        held, rows = [], 0

        def linked(cols, keys):
            row, root = cell_links(keys, cols[3].view(np.uint64), most)
            return pa.RecordBatch.from_pydict({"a": pa.array(cols[3][row]), "b": pa.array(cols[3][root])})

        for b in batches:
            held.append(tuple(np.asarray(b.column(c)) for c in ("choice", "cell", "band", "fp")))
            rows += b.num_rows
            if rows >= LEAST_ROWS:  # the last cell may go on: it waits, what is before is solved
                cols, keys, edges = solve(held)
                cut = int(edges[-1]) if len(edges) else 0
                if cut:
                    yield linked([c[:cut] for c in cols], keys[:cut])
                held, rows = [tuple(c[cut:] for c in cols)], rows - cut
        if rows:
            cols, keys, _ = solve(held)
            yield linked(cols, keys)

    return cells.mapInArrow(run, "a long, b long").distinct()


def to_unique(left: DataFrame, key: str, right: DataFrame, right_key: str, how: str = "inner") -> DataFrame:
    """left joined to a table with one row a key; rows of one key are dealt over SALTS tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SALTS)).cast("int")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.withColumn("_own", salt)
    return dealt.join(many, (F.col(key) == F.col(right_key)) & (F.col("_own") == F.col("_salt")), how).drop("_own", "_salt")


def components(edges: DataFrame, at: str) -> DataFrame:
    """(node, root) for every node of edges (a, b). Every round hooks each root to its least neighbour and jumps pointers.

    Only counts come to the driver. Each round at least halves the roots of a component, so rounds are few.
    """
    edges = written(edges.select("a", "b"), f"{at}/edges")
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), f"{at}/nodes0")
    k = 0
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("up")), f"{at}/hook{k}_0")
        j = 0
        while True:  # pointer jumping until every pointer is a root
            above = hook.select(F.col("a").alias("h"), F.col("up").alias("upper"))
            nxt = written(to_unique(hook, "up", above, "h").select("a", F.col("upper").alias("up"), (F.col("up") != F.col("upper")).alias("moved")), f"{at}/hook{k}_{j + 1}")
            moved = nxt.filter("moved").limit(1).count()
            hook, j = nxt.select("a", "up"), j + 1
            if not moved:
                break
        nodes = written(to_unique(nodes, "root", hook, "a", "left").select("node", F.coalesce("up", "root").alias("root")), f"{at}/nodes{k + 1}")
        left, right = hook.select("a", F.col("up").alias("ua")), hook.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        edges = written(edges.join(left, "a").join(right, "b").filter("ua != ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct(), f"{at}/edges{k + 1}")
        k += 1
    return nodes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): (doc_id, fp) of each document, and (fp, rep, root, component_id) of each distinct fingerprint."""
    at = work_dir(docs.sparkSession)
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), f"{at}/prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), f"{at}/distinct")
    nodes = components(links(distinct, most), f"{at}/cc")
    rooted = written(distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "root"), f"{at}/rooted")
    linked, single = rooted.filter("root IS NOT NULL"), rooted.filter("root IS NULL")
    ids = linked.groupBy(F.col("root").alias("of")).agg(F.min("rep").alias("component_id"))
    classes = to_unique(linked, "root", ids, "of").select("fp", "rep", "root", "component_id").unionByName(single.select("fp", "rep", F.col("fp").alias("root"), F.col("rep").alias("component_id")))
    return prints, written(classes, f"{at}/classes")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each group: that with the least id, of several such the one with the least fingerprint.

    Needs doc_id and text; returns docs' columns. Texts are exchanged only where an id is given to several rows.
    """
    prints, classes = near_duplicates(docs, **how)
    kept = classes.filter(F.col("rep") == F.col("component_id")).groupBy("root").agg(F.min("fp").alias("kept_fp"), F.min("rep").alias("kept_id"))
    again = prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("again"))
    out = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi")
    shingle = how.get("shingle", SHINGLE)
    if again.limit(1).count():  # such an id does not tell which row stands for the group: the fingerprint does
        shared = docs.join(again, docs["doc_id"] == again["again"], "left_semi")
        fps = shared.select("text").distinct().mapInArrow(_text_prints(shingle), "text string, fp long").select(F.col("text").alias("_text"), F.col("fp").alias("_fp"))
        rows = shared.join(fps, shared["text"].eqNullSafe(fps["_text"])).join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("_fp") == F.col("kept_fp")), "left_semi")
        out = out.join(again, out["doc_id"] == again["again"], "left_anti").unionByName(rows.dropDuplicates(["doc_id", "_fp"]).select(*[F.col(f"`{c}`") for c in docs.columns]))
    nameless = classes.filter("component_id IS NULL").select("fp", "root")
    if nameless.limit(1).count():  # groups without any id keep the first text
        bare = docs.filter(F.col("doc_id").isNull())
        firsts = bare.select("text").distinct().mapInArrow(_text_prints(shingle), "text string, fp long").join(nameless, "fp").groupBy("root").agg(F.min(F.coalesce("text", F.lit(""))).alias("kept"))
        out = out.unionByName(bare.join(firsts.select("kept"), F.coalesce(bare["text"], F.lit("")) == F.col("kept"), "left_semi").dropDuplicates(["text"]))
    return out


def _text_prints(shingle: int):
    def run(batches):
        for t in batches_by_bytes(batches, "text"):
            texts = array_of(t, "text")
            fp = np.frombuffer(b"".join(fingerprint(x, shingle) for x in texts.cast(pa.large_binary()).to_pylist()), ">i8").astype(np.int64)
            yield from pa.table({"text": pc.cast(texts, pa.string()), "fp": pa.array(fp)}).to_batches()

    return run


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    prints, classes = near_duplicates(table(spark, sf_dir, "documents"))
    return prints.join(classes.select("fp", "component_id"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
