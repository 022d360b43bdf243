"""Incremental ingest: elements that arrive become validated claims in the store, micro-batch by micro-batch.

A batch that is repeated after a failure changes nothing: the store knows its number.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.extract import extract, with_keys
from attestor.operators.validate import validate
from attestor.streaming import maintained


def finish(proposed: DataFrame, surfaces: dict[str, str] | None = None) -> DataFrame:
    """Proposed claims as the store keeps them: validated, with keys and with what relations and questions read."""
    checked = with_keys(validate(proposed.withColumn("lifecycle", F.lit("PROPOSED")).withColumn("raster", F.lit("n/a")), surfaces))
    checked = checked.withColumn("needs_review", F.col("lifecycle") == "DEMOTED")
    return checked if "derived_from" in checked.columns else checked.withColumn("derived_from", F.expr("cast(array() AS array<string>)"))


def start(elements: DataFrame, register: dict[str, str], store: str, checkpoint: str, surfaces: dict[str, str] | None = None):
    """The running query. elements: a stream with the columns of extract() and, if known, each document's derived_from;
    surfaces: names for the subject's layer of validate(). Claims and their relations are kept up by `maintained`."""

    def put(batch: DataFrame, number: int) -> None:
        proposed = extract(batch, register)
        if "derived_from" in batch.columns:
            sources = batch.groupBy("doc_id").agg(F.first("derived_from", ignorenulls=True).alias("derived_from"))
            proposed = proposed.join(sources, "doc_id").withColumn("derived_from", F.coalesce("derived_from", F.expr("cast(array() AS array<string>)")))
        maintained.put(batch.sparkSession, store, finish(proposed, surfaces), f"stream-{number}")

    return elements.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    return maintained.claims(spark, store, version)


def over_cap(events: DataFrame, user: str = "user_id", time: str = "ts", cap: int = 3, late: str = "10 minutes") -> DataFrame:
    """A rolling cap on a stream: users with more than cap events in a sliding hour, final once the watermark has passed."""
    w = events.withWatermark(time, late).groupBy(F.window(time, "1 hour", "10 minutes"), user).agg(F.count(F.lit(1)).alias("n"))
    return w.filter(F.col("n") > cap).select(user, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
