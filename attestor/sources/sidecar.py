"""Readings of images that were made elsewhere: transcriptions bound to a file by its digest, OCR variants, and drawings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.workers import shuffled


def bind(sidecars: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): sidecars (source, sha256, ...) are taken only for a file with the same path and digest."""
    f = files.select(F.col("doc_id").alias("source"), "sha256")
    return sidecars.join(f, ["source", "sha256"]), sidecars.join(f, ["source", "sha256"], "left_anti")


def agreement(tokens: str, ocr: str) -> str:
    """SQL: agree if all critical tokens stand in the OCR text, white space and case aside; n/a without tokens."""
    bare = lambda x: f"upper(regexp_replace({x}, '\\\\s+', ''))"
    return f"CASE WHEN size({tokens}) = 0 THEN 'n/a' WHEN forall({tokens}, t -> instr({bare(ocr)}, {bare('t')}) > 0) THEN 'agree' ELSE 'disagree' END"


def best_variant(variants: DataFrame, key: str) -> DataFrame:
    """Of each image's OCR variants (name, text, conf, valid_share) the one with the best score; ties by name, then text."""
    score = F.col("conf") * (F.lit(0.5) + F.col("valid_share"))
    return variants.groupBy(key).agg(F.max_by(F.struct("name", "text", score.alias("score")), F.struct(score, "name", "text")).alias("best")).select(key, "best.*")


def schematic_edges(lines: DataFrame, boxes: DataFrame, legend: DataFrame, eps: float = 3.0, tolerance: float = 0.02) -> DataFrame:
    """Lines of a drawing as edges between boxes: (drawing, line_id, src, dst, kind).

    An end belongs to the first box it lies in, give or take eps; the kind is the first legend row of nearly its colour.
    Ends and boxes meet in grid cells of the larger box size, so each end sees only boxes near it.
    """
    cell = 64.0
    b = boxes.withColumn("cx", F.explode(F.expr(f"sequence(cast(floor((x0 - {eps}) / {cell}) AS INT), cast(floor((x1 + {eps}) / {cell}) AS INT))")))
    b = b.withColumn("cy", F.explode(F.expr(f"sequence(cast(floor((y0 - {eps}) / {cell}) AS INT), cast(floor((y1 + {eps}) / {cell}) AS INT))")))
    ends = lines.selectExpr("drawing", "line_id", "r", "g", "b AS bl", "inline(array(named_struct('e', 'src', 'x', xa, 'y', ya), named_struct('e', 'dst', 'x', xb, 'y', yb)))")
    ends = ends.withColumn("cx", F.floor(F.col("x") / cell).cast("int")).withColumn("cy", F.floor(F.col("y") / cell).cast("int"))
    hit = ends.join(shuffled(b.select("drawing", "cx", "cy", "box_ord", "name", "x0", "y0", "x1", "y1")), ["drawing", "cx", "cy"]).filter(f"x BETWEEN x0 - {eps} AND x1 + {eps} AND y BETWEEN y0 - {eps} AND y1 + {eps}")
    at = hit.groupBy("drawing", "line_id", "r", "g", "bl").agg(F.min_by(F.when(F.col("e") == "src", F.col("name")), F.when(F.col("e") == "src", F.col("box_ord"))).alias("src"), F.min_by(F.when(F.col("e") == "dst", F.col("name")), F.when(F.col("e") == "dst", F.col("box_ord"))).alias("dst"))
    at = at.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    near = [F.abs(F.col(c) - F.col(f"l{c}")) <= tolerance for c in ("r", "g", "bl")]
    key = legend.select("drawing", "legend_ord", "kind", F.col("r").alias("lr"), F.col("g").alias("lg"), F.col("b").alias("lbl"))
    typed = at.join(shuffled(key), "drawing").filter(near[0] & near[1] & near[2])
    return typed.groupBy("drawing", "line_id", "src", "dst").agg(F.min_by("kind", "legend_ord").alias("kind"))
