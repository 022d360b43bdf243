"""BM25 ranking by joins on terms."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text

#: Up to so many terms of queries (some 10 MB) are sent to all executors; more are shuffled.
MOST_BROADCAST = 200_000


def top_k(queries: DataFrame, query_id: str, docs: DataFrame, doc_id: str, text_col: str = "text", k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank). Only terms that some query has leave the documents; lengths come from the same pass."""
    terms = queries.select(query_id, F.explode(F.array_distinct(F.expr(text.bm25_tokens(text_col)))).alias("t"))
    d = docs.select(doc_id, F.expr(text.bm25_tokens(text_col)).alias("ts"))
    sized = d.select(doc_id, F.size("ts").alias("dl"), "ts").filter("dl > 0")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("av"))
    wanted = terms.select("t").distinct()
    words = sized.select(doc_id, "dl", F.explode("ts").alias("t"))
    words = words.join(F.broadcast(wanted) if terms.count() <= MOST_BROADCAST else wanted, "t", "left_semi")
    # one exchange by document serves the counts and the scores
    per = words.repartition(doc_id).groupBy(doc_id, "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    df = per.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(df, "t").crossJoin(F.broadcast(stats)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))  # one row of statistics
    scored = per.join(F.broadcast(weighed) if terms.count() <= MOST_BROADCAST else weighed, "t")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("av")))
    total = scored.groupBy(query_id, doc_id).agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id))  # Spark keeps k of each task before the exchange
    return total.withColumn("rank", rank).filter(F.col("rank") <= k)
