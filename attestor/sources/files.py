"""Files: enumeration in path order, and the family and tier their path tells."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First full match wins: (pattern, family, tier). Fixed values.
FAMILIES = [
    (r"manuals/.*", "manual", "primary"),
    (r"engineering_bulletins/.*", "ecn", "primary"),
    (r"reference/alarm_reference.*", "manual", "primary"),
    (r"configuration/.*", "config", "primary"),
    (r"reference/.*", "reference", "reference"),
    (r"diagrams/.*", "diagram", "primary"),
    (r"extra/.*", "slides", "derived"),
    (r"low_trust/.*", "notes", "field_observation"),
    (r"noise/.*", "sds", "reference"),
    (r"screenshots/.*", "screenshot", "field_observation"),
    (r"scans/.*", "scan", "reference"),
]


def classify(path: Column, what: str = "family") -> Column:
    """family or tier of a relative path."""
    out = F.lit("unknown" if what == "family" else "reference")
    for pattern, family, tier in reversed(FAMILIES):
        out = F.when(path.rlike(f"^(?:{pattern})$"), family if what == "family" else tier).otherwise(out)
    return out


def files(spark: SparkSession, root: str, overrides: DataFrame | None = None) -> DataFrame:
    """(doc_id relative path, doc_ord, sha256, family, tier, content) of all files below root, hidden parts of the relative path left out.

    overrides: (doc_id, family, tier) that win over the path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    d = raw.select(F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/").alias("p"), "content").withColumn("doc_id", F.expr(f"substring(p, {len(base) + 2})")).filter(~F.col("doc_id").rlike(r"(^|/)\."))
    d = d.select("doc_id", F.sha2("content", 256).alias("sha256"), classify(F.col("doc_id")).alias("family"), classify(F.col("doc_id"), "tier").alias("tier"), "content")
    if overrides is not None:
        o = overrides.select("doc_id", F.col("family").alias("o_family"), F.col("tier").alias("o_tier"))
        d = d.join(o, "doc_id", "left").select("doc_id", "sha256", F.coalesce("o_family", "family").alias("family"), F.coalesce("o_tier", "tier").alias("tier"), "content")
    order = d.select("doc_id").orderBy("doc_id").withColumn("doc_ord", F.monotonically_increasing_id())  # ordered ids, not dense ones
    return d.join(order, "doc_id").select("doc_id", "doc_ord", "sha256", "family", "tier", "content")
