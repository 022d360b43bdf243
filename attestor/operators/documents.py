"""Documents as a table: printed numbers, what supersedes what, and what a document derives from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A printed document number, and its revision. Fixed values.
NUMBER = r"\b([A-Z]{2,4}-[A-Z]{2,4}-\d{3})\b"
REVISION = r"(?i)\brev(?:ision)?\.?\s*(\d+)\b"


def numbered(docs: DataFrame) -> DataFrame:
    """docs (doc_id, head, text, tier) with number and revision, read from the head, and the numbers that the text cites."""
    return docs.select(
        "doc_id", "tier", F.nullif(F.regexp_extract("head", NUMBER, 1), F.lit("")).alias("number"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(head, :p, 1), '') AS INT)".replace(":p", repr(REVISION).replace("\\\\", "\\").replace("\\", "\\\\"))), F.lit(0)).alias("revision"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER), 1)).alias("cites"),
    )


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, number, revision, supersedes, derived_from): a later document supersedes all earlier ones of its number, equal
    revisions by id; a derived one comes from the newest document of each number it cites, never from itself."""
    d = numbered(docs)
    own = d.filter("number IS NOT NULL").select("number", F.struct("revision", "doc_id").alias("at"))
    chains = own.groupBy("number").agg(F.array_sort(F.collect_list("at")).alias("chain"))  # the revisions of one document
    newest = own.groupBy("number").agg(F.max("at").alias("at")).select(F.col("number").alias("cited"), F.col("at.doc_id").alias("source"))
    came = d.filter("tier = 'derived'").select("doc_id", F.explode("cites").alias("cited")).join(newest, "cited").filter("source <> doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("source")).alias("derived_from"))
    out = d.join(chains, "number", "left").join(came, "doc_id", "left")
    earlier = "transform(filter(chain, x -> x.revision < revision OR (x.revision = revision AND x.doc_id < doc_id)), x -> x.doc_id)"
    none = "cast(array() AS array<string>)"
    return out.select("doc_id", "number", "revision", F.expr(f"coalesce({earlier}, {none})").alias("supersedes"), F.expr(f"coalesce(derived_from, {none})").alias("derived_from"))
