"""A full-text index on disk, and BM25 top-k from it without reading the documents.

Postings lie in blocks: those of one term in one window of a batch's documents, a row each. A window holds some WINDOW
documents of like length (a class of lengths, dealt by hash), so a block's largest count and least length bound what it can add
to a score, whatever the corpus's figures have become since. Rows are partitioned by the term's hash and sorted by term.

A query goes in two steps. Blocks' bounds are summed by window; the PROBE windows with the best bounds are scored, and their
k-th score is a true lower bound of the final one. Then just the windows whose bound reaches it are scored. No window that could
hold a result is left out, so rows equal those of a full scan (operators.bm25); blocks of other windows are not unpacked.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text
from attestor.functions.workers import stored
from attestor.sources.versions import Versions

#: Documents of a window, folders of a batch, parts of a folder, windows scored first for each query, and query terms that prune the read.
WINDOW, BUCKETS, SLICES, PROBE, MOST_PRUNED = 256, 32, 8, 8, 2000


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(placed: DataFrame) -> DataFrame:
    """(doc, dl, window, term, tf) from (doc, dl, window, ts): a document's tokens are counted where it lies, a batch of documents at a time."""
    import numpy as np
    import pyarrow as pa

    kind = placed.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = b.column(3)
            coded = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
            key, tf = np.unique(row * max(len(coded.dictionary), 1) + np.asarray(coded.indices), return_counts=True)
            row, term = (pa.array(x) for x in np.divmod(key, max(len(coded.dictionary), 1)))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(3)), coded.dictionary.take(term), pa.array(tf, pa.int32())], ["doc", "dl", "window", "term", "tf"])

    return placed.mapInArrow(run, f"doc {kind}, dl int, window long, term string, tf int")


def append(spark: SparkSession, path: str, docs: DataFrame, doc_id: str, name: str, text_col: str = "text") -> int:
    """Add a batch of documents to the index at `path` and return its version; a batch of a known name changes nothing.

    Documents without a token are not in the index. An id belongs to one batch; a null id is an id like any other.
    """
    index = Versions(spark, path)
    base, folder = index.latest(), index.folder()
    if any(b["name"] == name for b in index.batches(base)):
        return base
    tokens = docs.select(F.col(doc_id).alias("doc"), F.expr(text.bm25_tokens(text_col)).alias("ts")).withColumn("dl", F.size("ts")).filter("dl > 0")
    tokens = tokens.withColumn("class", F.floor(4 * F.log2("dl")).cast("int"))
    sizes = tokens.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length")).collect()  # at most 124 classes
    parts = spark.createDataFrame([(r["class"], -(-r["n"] // WINDOW)) for r in sizes], "class int, parts long")
    placed = tokens.join(F.broadcast(parts), "class").withColumn("window", F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("doc"), "parts"))
    counted = _counted(placed.select("doc", "dl", "window", "ts")).withColumns({"bucket": bucket(), "slice": F.pmod("window", F.lit(SLICES))})
    # one exchange for groups and files; a common term is cut by windows
    dealt = counted.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "window")
    blocks = dealt.agg(F.array_sort(F.collect_list(F.struct("doc", "tf", "dl"))).alias("postings"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    blocks = blocks.drop("slice").withColumn("batch", F.lit(base + 1))  # a block has the documents of one window at most
    blocks.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(folder)
    return index.commit(name, folder, base, docs=sum(r["n"] for r in sizes), length=sum(r["length"] for r in sizes), schema=blocks.schema.json())


def blocks(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame | None, int, int]:
    """(blocks of a version, its documents, its tokens); None where the index is empty."""
    held = [b for b in Versions(spark, path).batches(version) if b["docs"]]
    if not held:
        return None, 0, 0
    from pyspark.sql.types import StructType
    import json

    schema = StructType.fromJson(json.loads(held[0]["schema"]))
    reads = [spark.read.schema(schema).parquet(b["folder"]) for b in held]
    whole = reads[0]
    for r in reads[1:]:
        whole = whole.unionByName(r)
    return whole, sum(b["docs"] for b in held), sum(b["length"] for b in held)


def reach(weighed: DataFrame, heads: DataFrame, query_id: str, k1: float, b: float, average: float) -> DataFrame:
    """(query, batch, window, bound): no document of the window scores higher for the query."""
    return heads.join(weighed, "term").groupBy(query_id, "batch", "window").agg(F.sum(F.col("idf") * part("max_tf", "min_dl", k1, b, average)).alias("bound"))


def part(tf: str, dl: str, k1: float, b: float, average: float) -> Column:
    return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.lit(average)))


def scored(windows: DataFrame, weighed: DataFrame, found: DataFrame, query_id: str, k: int, k1: float, b: float, average: float) -> DataFrame:
    """The k best documents (query, doc, score, rank) of these windows of each query."""
    met = windows.join(weighed, query_id).join(found.select("term", "batch", "window", "postings"), ["term", "batch", "window"])
    each = met.select(query_id, "idf", F.inline("postings"))
    total = each.groupBy(query_id, "doc").agg(F.round(F.sum(F.col("idf") * part("tf", "dl", k1, b, average)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "doc"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k)


def candidates(spark: SparkSession, path: str, queries: DataFrame, query_id: str, text_col: str = "text", k: int = 10, k1: float = 1.5, b: float = 0.75, version: int | None = None) -> dict | None:
    """What top_k scores: {windows with bound and `kept`, weights of query terms, their blocks, average length}; None for an empty index."""
    whole, n, length = blocks(spark, path, version)
    if whole is None:
        return None
    terms = queries.select(query_id, F.explode(F.array_distinct(F.expr(text.bm25_tokens(text_col)))).alias("term"))
    few = [r["term"] for r in terms.select("term").distinct().limit(MOST_PRUNED + 1).collect()]
    if len(few) <= MOST_PRUNED:  # folders and row groups without any of them are not read
        buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in few], "term string").select(bucket().alias("b")).distinct().collect()]
        found = whole.filter(F.col("bucket").isin(buckets) & F.col("term").isin(few))
    else:
        found = whole.join(terms.select("term").distinct(), "term", "left_semi")
    heads, average = found.select("term", "batch", "window", "n", "max_tf", "min_dl"), length / n
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    weighed = stored(terms.join(df, "term").select(query_id, "term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")), "weights")
    windows = stored(reach(weighed, heads, query_id, k1, b, average), "windows")
    first = windows.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("bound"), "batch", "window"))).filter(F.col("place") <= PROBE)
    least = scored(first.select(query_id, "batch", "window"), weighed, found, query_id, k, k1, b, average).filter(F.col("rank") == k).select(query_id, F.col("score").alias("least"))
    slack = 1e-5  # scores are rounded at the sixth digit
    judged = windows.join(least, query_id, "left").withColumn("kept", F.coalesce(F.col("bound") + slack >= F.col("least"), F.lit(True)))
    return {"windows": judged, "weighed": weighed, "found": found, "average": average}


def top_k(spark: SparkSession, path: str, queries: DataFrame, query_id: str, doc_id: str, text_col: str = "text", k: int = 10, k1: float = 1.5, b: float = 0.75, version: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) for a batch of queries, from the index as of a version."""
    c = candidates(spark, path, queries, query_id, text_col, k, k1, b, version)
    if c is None:
        return queries.limit(0).selectExpr(query_id, f"cast(NULL AS bigint) AS {doc_id}", "cast(NULL AS double) AS score", "cast(NULL AS int) AS rank")
    kept = c["windows"].filter("kept").select(query_id, "batch", "window")
    return scored(kept, c["weighed"], c["found"], query_id, k, k1, b, c["average"]).select(query_id, F.col("doc").alias(doc_id), "score", "rank")
