"""The claim store: one Parquet table per kind, replaced as a whole, and the hash of its visible content."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "elements", "evidence", "claims", "relations", "entities", "aliases", "claim_audit", "derivations", "mentions"]


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables; claims by predicate and relations by kind, so that reads prune."""
    by = {"claims": ["predicate"], "relations": ["kind"]}
    for name, df in tables.items():
        out = df.write.mode("overwrite")
        if name in by and set(by[name]) <= set(df.columns):
            out = out.partitionBy(*by[name])
        out.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names=TABLES) -> dict[str, DataFrame]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = {}
    for name in names:
        p = hadoop.Path(f"{path}/{name}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            found[name] = spark.read.parquet(f"{path}/{name}")
    return found


def content_hash(claims: DataFrame, by: str = "doc_id", row=("claim_id", "vkey", "lifecycle")) -> DataFrame:
    """(store_hash, documents): rows in id order hashed per document, then a tree of hashes over the documents.

    A node has at most 256 children, by two digits of the hash of the document's id, so no task concatenates more than one
    document's rows or 256 hashes (and at the lowest level the documents that share six digits).
    """

    def fold(rows: DataFrame, group, key: str, text) -> DataFrame:
        said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), text.alias("t")))), lambda x: x["t"]), "\n")
        return rows.groupBy(group).agg(F.sha2(said, 256).alias("h"), F.sum("n").alias("n"))

    own = claims.select(by, F.col(row[0]).alias("id"), F.concat_ws("|", *row).alias("t"), F.lit(0).alias("n"))
    level = fold(own, F.col(by), "id", F.col("t")).withColumn("n", F.lit(1).cast("long"))
    key, prefix = by, F.substring(F.sha2(F.col(by).cast("string"), 256), 1, 6)
    for digits in (4, 2, 0):
        level = fold(level, prefix.alias(f"p{digits}"), key, F.concat_ws(":", F.col(key), F.col("h")))
        key, prefix = f"p{digits}", F.substring(F.col(f"p{digits}"), 1, digits)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), F.concat_ws(":", F.col(key), F.col("h")).alias("t")))), lambda x: x["t"]), "\n")
    return level.agg(F.substring(F.sha2(top, 256), 1, 16).alias("store_hash"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("documents"))
