"""Mixing sources to target weights.

Documents get hash-random keys and are ranged by key within their source. Prefix sums of word counts are taken over key
ranges in two levels of 4096 ranges each, so a source of any size costs bounded windows: totals per (source, range) first,
then only the range that holds the cut is opened. The mix is a full pass over the source for every whole epoch of its
budget, and the documents before the cut once more; the document at the cut gives exactly the words that are left.

Defined results: a null text has size 0; null sources form one source, ordered last; a null id has the key of the empty
text; rows equal in id and size at the cut share what is left evenly (rounded down); an empty table gives an empty result.
Other columns of the input are never read, so they may have any names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.llm.common import WORD, WS, id_text, table, work_dir, written

WEIGHTS, SHARE, CAP, DIGITS = (3, 1, 2), 1.5, 2, 3


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, full, rest): one row per source.

    Shares by weight stop at cap x size and the excess is shared anew, until none is above: the common level of the
    sources that stay below their cap, found by one pass in order of cap / weight. One row per source is all it reads.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * cap).cast("double"))
    every = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(every) * share).withColumn("all_w", F.sum("w").over(every))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("level", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))) / (F.col("all_w") - (F.sum("w").over(upto) - F.col("w")))).withColumn("place", F.row_number().over(order))
    per = per.withColumn("below", F.col("cap") / F.col("w") > F.col("level"))
    per = per.withColumn("common", F.min_by(F.when(F.col("below"), F.col("level")), F.when(F.col("below"), F.col("place"))).over(every))
    per = per.withColumn("target", F.when(F.col("below"), F.least(F.col("cap"), F.col("common") * F.col("w"))).otherwise(F.col("cap")))
    budget = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * cap)
    per = per.withColumn("budget", budget).withColumn("full", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    return per.select("source", "source_size", "target", "full", (F.col("budget") - F.col("full") * F.col("source_size")).alias("rest"))


def cuts(sizes: DataFrame, per: DataFrame, digits: int = DIGITS) -> DataFrame:
    """per, with (cut_key, cut_size, part): where the last, partial epoch of each source ends."""
    open_ = per.select(F.col("source").alias("s"), F.col("rest").alias("left"), F.lit("").alias("prefix"))
    same = F.col("source").eqNullSafe(F.col("s"))
    for level in (1, 2):
        here = F.substring("key", 1, level * digits)
        inside = sizes.join(open_, same & (F.substring("key", 1, (level - 1) * digits) == F.col("prefix")))
        sums = inside.groupBy("s", "left", here.alias("range")).agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        at = sums.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("n")))
        open_ = at.select("s", (F.col("left") - F.col("before")).alias("left"), F.col("range").alias("prefix"))
    inside = sizes.join(open_, same & (F.substring("key", 1, 2 * digits) == F.col("prefix")))
    ties = inside.groupBy("s", "left", "key", "size").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum(F.col("m") * F.col("size")).over(Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m") * F.col("size")
    at = ties.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("m") * F.col("size")))
    at = at.select("s", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.expr("(left - before) div m").alias("part"))
    return per.join(at, same, "left").drop("s")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): id, source, size, key of each document, written once, and the one row per source that decides it all."""
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(id_text(id_col).cast("binary")).alias("key"))
    at = work_dir(docs.sparkSession)
    sizes = written(sizes, f"{at}/sizes")
    return sizes, written(cuts(sizes, targets(sizes, weights, share, cap)), f"{at}/plan")


def taken(size: str = "size", key: str = "key") -> Column:
    """Words that the mix takes of a document, repeats counted."""
    before = F.struct(F.col(key), F.col(size)) < F.struct(F.col("cut_key"), F.col("cut_size"))
    at = (F.col(key) == F.col("cut_key")) & (F.col(size) == F.col("cut_size"))
    extra = F.when(F.col("cut_key").isNull(), F.lit(0)).when(at, F.col("part")).when(before, F.col(size)).otherwise(F.lit(0))
    return (F.col("full") * F.col(size) + extra).cast("long")


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with size and key joined to their source's plan. The plan has a row per source; Spark broadcasts it when it is small and splits hot sources when not."""
    p = plan.withColumnRenamed("source", "plan_source")
    return rows.join(p, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source").withColumn("taken", taken())


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: a row for each epoch that takes the document; the one at the cut keeps its first words.

    Needs doc_id, text, source; returns docs' columns. Documents without words are not taken.
    """
    _, plan = mix(docs, **how)
    d = docs.alias("d")
    rows = d.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns]).alias("row"), F.col("d.source").alias("source"), word_count(F.col("d.text")).alias("size"), F.md5(id_text("d.doc_id").cast("binary")).alias("key"))
    rows = decide(rows, plan).filter("taken > 0")
    rows = rows.withColumn("words", F.explode(F.expr("transform(sequence(1L, (taken + size - 1) div size), e -> least(size, taken - (e - 1) * size))")))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(rf"([{WS}]*[^{WS}]+)"), F.lit(1)), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(first)
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    sizes, plan = mix(table(spark, sf_dir, "documents"))
    return decide(sizes, plan).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w,
             CAST(source_size * 2 AS DOUBLE) AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total FROM s),
l AS (SELECT *, (total - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS lvl, row_number() OVER o AS place
      FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT source, source_size, CASE WHEN cap / w > lvl THEN least(cap, w * (SELECT arg_min(lvl, place) FROM l WHERE cap / w > lvl)) ELSE cap END AS target FROM l),
b AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), source_size * 2) AS budget FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS full_, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS rest FROM b),
g AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.full_, p.rest, count(*) OVER (PARTITION BY d.source, d.k, d.size) AS m,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
             - d.size * count(*) OVER (PARTITION BY d.source, d.k, d.size) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(full_ * size + CASE WHEN before + m * size <= rest THEN size WHEN before <= rest THEN (rest - before) // m ELSE 0 END AS BIGINT) AS taken, source
FROM g
"""
