"""Claims derived from lineitem and orders, the same in Spark and in SQL, so that every operator has data of any size.

Claim ids are fixed-width texts in the order of the key (order, line, part, supplier, price), which is unique.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions.version import version_key

PREDICATES = ["normal_operating_pressure", "config_key_value", "located_at", "requires_state", "observed_pressure"]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")  # noqa: E741
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.selectExpr(
        "concat('C', lpad(l_orderkey, 10, '0'), lpad(l_linenumber, 2, '0'), lpad(l_partkey, 9, '0'), lpad(l_suppkey, 8, '0'), lpad(cast(round(l_extendedprice * 100) AS BIGINT), 12, '0')) AS claim_id",
        "concat('component:', l_partkey) AS entity_id",
        f"element_at(array({', '.join(repr(p) for p in PREDICATES)}), cast(l_suppkey % 5 AS INT) + 1) AS predicate",
        "cast(l_quantity AS INT) % 3 AS q",
        "l_linenumber % 5 AS n",
        "concat('1.', 10 + month(l_shipdate) % 6) AS v",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'reference' WHEN '3-MEDIUM' THEN 'derived' ELSE 'field_observation' END AS tier",
        "CASE l_returnflag WHEN 'A' THEN 'stated' WHEN 'N' THEN 'structural' ELSE 'inferred' END AS assertion_kind",
        "CASE WHEN l_discount > 0.095 THEN 'REJECTED' WHEN l_linestatus = 'F' THEN 'ADMITTED' ELSE 'DEMOTED' END AS lifecycle",
        "l_linestatus = 'O' AS needs_review",
        "concat('doc:', l_orderkey % 40) AS doc_id",
        "cast(l_orderkey % 40 AS INT) AS doc_no",
        # every fifth document derives from the one before
        "IF(l_orderkey % 5 = 0 AND l_orderkey % 40 > 0, array(concat('doc:', l_orderkey % 40 - 1)), cast(array() AS array<string>)) AS derived_from",
        "l_suppkey",
        "l_orderkey",
    )
    j = j.selectExpr(
        "claim_id", "entity_id", "predicate", "tier", "assertion_kind", "lifecycle", "needs_review", "doc_id", "doc_no", "derived_from", "l_orderkey",
        "CASE predicate WHEN 'located_at' THEN 'text' WHEN 'requires_state' THEN 'state' ELSE 'quantity' END AS value_type",
        "IF(predicate IN ('located_at', 'requires_state'), NULL, cast(150 + 10 * q AS DOUBLE)) AS value",
        "IF(predicate IN ('located_at', 'requires_state'), NULL, 'bar') AS unit",
        "CASE predicate WHEN 'located_at' THEN concat(' Zone ', q) WHEN 'requires_state' THEN concat('S', q) END AS v_text",
        "IF(predicate = 'requires_state', concat('item', q % 2), NULL) AS item",
        "CASE n WHEN 0 THEN 'any' WHEN 4 THEN 'unknown' ELSE 'ver' END AS rev_kind",
        "IF(n IN (1, 3), v, NULL) AS rev_lo", "IF(n IN (2, 3), v, NULL) AS rev_hi", "true AS rev_lo_inc", "n = 3 AS rev_hi_inc",
        "CASE WHEN tier = 'field_observation' AND l_suppkey % 7 < 5 THEN 'unknown' WHEN l_suppkey % 7 < 2 THEN 'ent' ELSE 'any' END AS sensor_kind",
        "IF(l_suppkey % 7 < 2 AND tier <> 'field_observation', array(IF(l_suppkey % 7 = 0, 'component:PS-04', 'component:PS-04A')), cast(array() AS array<string>)) AS sensor_ids",
    )
    j = j.withColumn("vkey", F.expr("CASE value_type WHEN 'quantity' THEN concat('q:', value, ':', unit) WHEN 'text' THEN concat('text:', lower(trim(v_text))) ELSE concat('s:', item, ':', lower(v_text)) END"))
    return j.withColumn("lo_k", F.expr(version_key("rev_lo"))).withColumn("hi_k", F.expr(version_key("rev_hi")))


def duck_key(v: str) -> str:
    return f"(CASE WHEN {v} IS NULL THEN NULL ELSE list_resize(list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT)), greatest(len(string_split({v}, '.')), 4), 0) END)"


#: The same in SQL, as the head of a WITH clause.
CLAIMS_SQL = f"""WITH raw AS (
  SELECT 'C' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || lpad(CAST(l_partkey AS VARCHAR), 9, '0')
             || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') AS claim_id,
         'component:' || l_partkey AS entity_id,
         [{', '.join(repr(p) for p in PREDICATES)}][CAST(l_suppkey % 5 AS INT) + 1] AS predicate,
         CAST(l_quantity AS INT) % 3 AS q, l_linenumber % 5 AS n, '1.' || (10 + month(l_shipdate) % 6) AS v,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'reference' WHEN '3-MEDIUM' THEN 'derived' ELSE 'field_observation' END AS tier,
         CASE l_returnflag WHEN 'A' THEN 'stated' WHEN 'N' THEN 'structural' ELSE 'inferred' END AS assertion_kind,
         CASE WHEN l_discount > 0.095 THEN 'REJECTED' WHEN l_linestatus = 'F' THEN 'ADMITTED' ELSE 'DEMOTED' END AS lifecycle,
         l_linestatus = 'O' AS needs_review, 'doc:' || (l_orderkey % 40) AS doc_id, CAST(l_orderkey % 40 AS INT) AS doc_no,
         CASE WHEN l_orderkey % 5 = 0 AND l_orderkey % 40 > 0 THEN ['doc:' || (l_orderkey % 40 - 1)] ELSE [] END AS derived_from, l_suppkey, l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
flat AS (
  SELECT claim_id, entity_id, predicate, tier, assertion_kind, lifecycle, needs_review, doc_id, doc_no, derived_from, l_orderkey,
         CASE predicate WHEN 'located_at' THEN 'text' WHEN 'requires_state' THEN 'state' ELSE 'quantity' END AS value_type,
         CASE WHEN predicate IN ('located_at', 'requires_state') THEN NULL ELSE CAST(150 + 10 * q AS DOUBLE) END AS value,
         CASE WHEN predicate IN ('located_at', 'requires_state') THEN NULL ELSE 'bar' END AS unit,
         CASE predicate WHEN 'located_at' THEN ' Zone ' || q WHEN 'requires_state' THEN 'S' || q END AS v_text,
         CASE WHEN predicate = 'requires_state' THEN 'item' || (q % 2) END AS item,
         CASE n WHEN 0 THEN 'any' WHEN 4 THEN 'unknown' ELSE 'ver' END AS rev_kind,
         CASE WHEN n IN (1, 3) THEN v END AS rev_lo, CASE WHEN n IN (2, 3) THEN v END AS rev_hi, true AS rev_lo_inc, n = 3 AS rev_hi_inc,
         CASE WHEN tier = 'field_observation' AND l_suppkey % 7 < 5 THEN 'unknown' WHEN l_suppkey % 7 < 2 THEN 'ent' ELSE 'any' END AS sensor_kind,
         CASE WHEN l_suppkey % 7 < 2 AND tier <> 'field_observation' THEN [CASE WHEN l_suppkey % 7 = 0 THEN 'component:PS-04' ELSE 'component:PS-04A' END] ELSE [] END AS sensor_ids
  FROM raw),
claims AS (
  SELECT *, CASE value_type WHEN 'quantity' THEN 'q:' || value || ':' || unit WHEN 'text' THEN 'text:' || lower(trim(v_text)) ELSE 's:' || item || ':' || lower(v_text) END AS vkey,
         {duck_key('rev_lo')} AS lo_k, {duck_key('rev_hi')} AS hi_k FROM flat),
visible AS (SELECT * FROM claims WHERE lifecycle IN ('ADMITTED', 'DEMOTED'))"""


def _duck_past(x: str, y: str) -> str:
    return f"coalesce({x}lo_k > {y}hi_k OR ({x}lo_k = {y}hi_k AND NOT ({x}rev_lo_inc AND {y}rev_hi_inc)), false)"


def duck_rev_relation(a: str, b: str) -> str:
    return f"""CASE WHEN {a}rev_kind = 'unknown' OR {b}rev_kind = 'unknown' THEN 'UNKNOWN' WHEN {a}rev_kind = 'any' OR {b}rev_kind = 'any' THEN 'OVERLAP'
        WHEN {_duck_past(a, b)} OR {_duck_past(b, a)} THEN 'DISJOINT' ELSE 'OVERLAP' END"""


def duck_relation(a: str = "a.", b: str = "b.") -> str:
    rev = duck_rev_relation(a, b)
    sensor = f"""CASE WHEN {a}sensor_kind = 'unknown' OR {b}sensor_kind = 'unknown' THEN 'UNKNOWN' WHEN {a}sensor_kind = 'any' OR {b}sensor_kind = 'any' THEN 'OVERLAP'
        WHEN list_has_any({a}sensor_ids, {b}sensor_ids) THEN 'OVERLAP' ELSE 'DISJOINT' END"""
    return f"CASE WHEN ({rev}) = 'DISJOINT' OR ({sensor}) = 'DISJOINT' THEN 'DISJOINT' WHEN ({rev}) = 'UNKNOWN' OR ({sensor}) = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'OVERLAP' END"


def duck_wider(o: str, i: str) -> str:
    """SQL: revision scope o strictly contains i, by the bounds of the synthetic claims (lower bounds are all inclusive)."""
    lo_in = f"({o}lo_k IS NULL OR coalesce({i}lo_k >= {o}lo_k, false))"
    hi_in = f"({o}hi_k IS NULL OR coalesce({i}hi_k < {o}hi_k OR ({i}hi_k = {o}hi_k AND ({o}rev_hi_inc OR NOT {i}rev_hi_inc)), false))"
    same = f"({o}lo_k IS NOT DISTINCT FROM {i}lo_k AND {o}hi_k IS NOT DISTINCT FROM {i}hi_k AND ({o}hi_k IS NULL OR {o}rev_hi_inc = {i}rev_hi_inc))"
    return f"(CASE WHEN {o}rev_kind = 'any' THEN {i}rev_kind <> 'any' WHEN {o}rev_kind = 'ver' AND {i}rev_kind = 'ver' THEN {lo_in} AND {hi_in} AND NOT {same} ELSE false END)"


def duck_describe(p: str = "") -> str:
    return f"""CASE WHEN {p}rev_kind <> 'ver' THEN {p}rev_kind WHEN {p}rev_lo = {p}rev_hi AND {p}rev_lo_inc AND {p}rev_hi_inc THEN '=' || {p}rev_lo
        WHEN {p}rev_lo IS NOT NULL AND {p}rev_hi IS NULL THEN CASE WHEN {p}rev_lo_inc THEN '≥' ELSE '>' END || {p}rev_lo
        WHEN {p}rev_hi IS NOT NULL AND {p}rev_lo IS NULL THEN CASE WHEN {p}rev_hi_inc THEN '≤' ELSE '<' END || {p}rev_hi
        WHEN {p}rev_lo IS NOT NULL THEN CASE WHEN {p}rev_lo_inc THEN '[' ELSE '(' END || {p}rev_lo || ', ' || {p}rev_hi || CASE WHEN {p}rev_hi_inc THEN ']' ELSE ')' END
        ELSE 'all versions' END"""
