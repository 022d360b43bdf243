"""Queries on what follows from claims, what falls with them, and what validation catches; each with its SQL counterpart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import derive, mutate
from attestor.operators.validate import ACTION, COMPARED, SELF_DESCRIBING
from attestor.plans.ontology import listed
from attestor.plans.testbed import CLAIMS_SQL, claims, duck_describe, duck_key, duck_relation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


CHAINS = (derive.Chain("R-SUPERSEDED-CHAIN", "superseded_by", "superseded_by", "superseded_by"),)


def linked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start-up states stand for supersessions, each part by the next, in chains of eight; quantities are those of their part."""
    c = claims(spark, sf_dir).withColumn("part", F.expr("cast(substring(entity_id, 11) AS BIGINT)"))
    return c.withColumns({
        "value_id": F.expr("IF(predicate = 'requires_state' AND part % 8 < 7, concat('component:', part + 1), NULL)"),
        "predicate": F.expr("IF(predicate = 'requires_state', 'superseded_by', predicate)"),
        "value": F.expr("value + 1000 * part"),
    }).drop("part")


def _derived_sql(stay: str) -> str:
    """SQL: (derived_id, rule, first_use, other_use) of the claims for which `stay` holds."""
    lo_b = "(b.lo_k IS NOT NULL AND (a.lo_k IS NULL OR b.lo_k > a.lo_k))"
    hi_b = "(b.hi_k IS NOT NULL AND (a.hi_k IS NULL OR b.hi_k < a.hi_k OR (b.hi_k = a.hi_k AND NOT b.rev_hi_inc)))"
    take = lambda c, pick: f"CASE WHEN a.rev_kind = 'any' THEN b.{c} WHEN b.rev_kind = 'any' THEN a.{c} WHEN {pick} THEN b.{c} ELSE a.{c} END"
    sides = f"""SELECT a.claim_id AS first_use, b.claim_id AS other_use, a.entity_id, b.value_id, CASE WHEN a.rev_kind = 'any' THEN b.rev_kind ELSE a.rev_kind END AS rev_kind,
            {take('rev_lo', lo_b)} AS rev_lo, {take('rev_hi', hi_b)} AS rev_hi, true AS rev_lo_inc, {take('rev_hi_inc', hi_b)} AS rev_hi_inc, {take('lo_k', lo_b)} AS lo_k, {take('hi_k', hi_b)} AS hi_k,
            CASE WHEN a.sensor_kind = 'any' THEN b.sensor_kind ELSE a.sensor_kind END AS sensor_kind,
            CASE WHEN a.sensor_kind = 'any' THEN b.sensor_ids WHEN b.sensor_kind = 'any' THEN a.sensor_ids ELSE list_sort(list_intersect(a.sensor_ids, b.sensor_ids)) END AS sensor_ids, a.tier, a.doc_id"""
    on = f"a.value_id = b.entity_id AND a.entity_id <> b.value_id AND {duck_relation()} = 'OVERLAP'"
    named = f"concat_ws('|', 'I:superseded_by', entity_id, value_id, {duck_describe()}, concat_ws(',', sensor_kind, nullif(array_to_string(sensor_ids, ','), '')), doc_id, tier)"
    fact = "claim_id, entity_id, value_id, rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, lo_k, hi_k, sensor_kind, sensor_ids, tier, doc_id"
    head = CLAIMS_SQL.replace("WITH raw", "WITH RECURSIVE raw", 1)
    return f"""{head}, own AS (SELECT *, CAST(substr(entity_id, 11) AS BIGINT) AS part FROM visible WHERE {stay}),
    sup AS (SELECT *, CASE WHEN part % 8 < 7 THEN 'component:' || (part + 1) END AS value_id FROM own WHERE predicate = 'requires_state' AND assertion_kind = 'stated' AND NOT needs_review),
    base AS (SELECT {fact} FROM sup WHERE value_id IS NOT NULL),
    inf AS (SELECT {named} AS claim_id, {fact.removeprefix('claim_id, ')} FROM ({sides} FROM base a JOIN base b ON {on}) x
        UNION SELECT {named}, {fact.removeprefix('claim_id, ')} FROM ({sides} FROM inf a JOIN base b ON {on}) y),
    chained AS (SELECT {named} AS derived_id, first_use, other_use FROM ({sides} FROM (SELECT * FROM base UNION ALL SELECT * FROM inf) a JOIN base b ON {on}) z)
    SELECT derived_id, 'R-SUPERSEDED-CHAIN' AS rule, first_use, other_use FROM chained
    UNION ALL SELECT 'I:R-SUPERSEDED-DISTINCT:' || claim_id, 'R-SUPERSEDED-DISTINCT', claim_id, NULL FROM base
    UNION ALL SELECT 'I:R-CFGKEY-01:' || a.claim_id, 'R-CFGKEY-01', a.claim_id, b.claim_id FROM own a JOIN own b ON a.part = b.part AND a.value = b.value AND {duck_relation()} = 'OVERLAP'
        WHERE a.predicate = 'config_key_value' AND b.predicate = 'normal_operating_pressure' AND b.assertion_kind = 'stated' AND NOT b.needs_review"""


def _uses(derivations: DataFrame) -> DataFrame:
    return derivations.select("derived_id", "rule", F.expr("uses[0]").alias("first_use"), F.expr("get(uses, 1)").alias("other_use"))


@query(_derived_sql("true"))
def derivations(spark, sf_dir):
    """Every derivation, links of chains to their ends included."""
    return _uses(derive.infer(linked_claims(spark, sf_dir), CHAINS).derivations)


@query(_derived_sql("doc_no NOT IN (3, 17)"))
def derivations_after_withdrawal(spark, sf_dir):
    """Two documents are withdrawn once all is derived: what still holds is what would follow without them."""
    c = linked_claims(spark, sf_dir)
    return _uses(derive.retract(derive.infer(c, CHAINS), c, c.filter("doc_no IN (3, 17)").select("claim_id")).derivations)


NAMES = ["PS-04", "PS-04A", "PS-40", "PS-41"]


def quoted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the sentences they are read from. Subjects are named or not, cues stated or left out, second values stand beside the first."""
    c = claims(spark, sf_dir).withColumn("n", F.expr("cast(substring(claim_id, 2, 10) AS BIGINT) % 7")).withColumn("name", F.expr(f"element_at(array({listed(NAMES)}), cast(substring(entity_id, 11) AS INT) % 4 + 1)"))
    c = c.withColumn("alarm", F.expr("value_type = 'quantity' AND n = 1")).withColumn("half", F.expr("rev_kind = 'ver'"))
    said = """concat(IF(predicate = 'requires_state' AND n IN (3, 5), 'Do not run. ', ''), IF(n = 2, 'It', name),
        CASE value_type WHEN 'quantity' THEN concat(CASE n WHEN 5 THEN ' opens above ' WHEN 1 THEN ' warns below ' ELSE ' reads ' END, cast(value AS INT), ' bar', IF(n = 0, concat(' or ', cast(value AS INT) + 10, ' bar'), ''))
            WHEN 'text' THEN concat(' stands in ', trim(v_text)) ELSE concat(' must be ', lower(v_text)) END,
        CASE WHEN rev_kind <> 'ver' OR doc_no % 11 = 0 THEN '' WHEN rev_hi IS NULL THEN concat(' on software revision ', rev_lo, ' and later')
            WHEN rev_lo IS NULL THEN concat(' before software revision ', rev_hi) ELSE concat(' on software revision ', rev_lo, ' and ', rev_hi, ' only') END, '.')"""
    return c.selectExpr(
        "claim_id", "lifecycle", "needs_review", "assertion_kind", "CASE WHEN alarm THEN 'alarm:E1' WHEN predicate = 'config_key_value' THEN 'config:K1' ELSE concat('component:', name) END AS entity_id",
        "CASE WHEN n = 6 THEN 'unheard_of' WHEN alarm THEN 'alarm_trigger_condition' WHEN value_type = 'quantity' AND n = 5 AND predicate <> 'config_key_value' THEN 'reset_pressure_limit' ELSE predicate END AS predicate",
        "IF(alarm, 'condition', value_type) AS value_type", "IF(alarm, NULL, value) AS value", "IF(alarm, NULL, value) AS raw", "IF(alarm, NULL, unit) AS unit", "trim(v_text) AS v_text", "cast(NULL AS array<string>) AS items", "cast(NULL AS string) AS value_id",
        "IF(n = 5, 'fact', 'requirement') AS modality", "CASE WHEN alarm THEN '<' WHEN value_type = 'quantity' AND n = 5 THEN '>' END AS cond_op", "IF(alarm OR n = 5, value, NULL) AS cond_raw",
        "rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "IF(half, 'explicit_cue', 'document_default') AS basis", "'n/a' AS raster", f"{said} AS quote", "n",
    ).withColumn("element_text", F.expr("IF(n = 4 AND value_type = 'text', 'Another text.', concat('Heading.  ', quote, ' Rest.'))")).drop("n")


_VERSION = r"([0-9]+(?:\.[0-9]+)*)"
_PROHIBITED = r"regexp_matches(quote, '(?i)\b(do not|must not|never)\b')"
_HAD = "predicate IN ('reset_pressure_limit', 'alarm_required_action') AND cond_op IS NOT NULL"
_CORRUPT = [
    ("none", "true", ""),
    ("scope_widened", "basis = 'explicit_cue' AND rev_kind = 'ver'", "'any' AS rev_kind, NULL AS rev_lo, NULL AS rev_hi, true AS rev_lo_inc, true AS rev_hi_inc, 'document_default' AS basis"),
    ("scope_flipped", "basis = 'explicit_cue' AND rev_kind = 'ver' AND (rev_lo IS NULL) <> (rev_hi IS NULL)", "rev_hi AS rev_lo, rev_lo AS rev_hi, true AS rev_lo_inc, false AS rev_hi_inc"),
    ("value_swapped", "value_type = 'quantity' AND predicate NOT IN ('flash_point', 'pour_point')", "raw + 10 AS raw, value + 10 AS value"),
    ("unit_swapped", "value_type = 'quantity' AND unit = 'bar'", "'psi' AS unit"),
    ("negation_dropped", f"predicate IN ({listed(ACTION)}) AND modality <> 'fact' AND {_PROHIBITED}", "'fact' AS modality"),
    ("modality_weakened_no_cue", f"predicate IN ({listed(ACTION)}) AND modality <> 'fact' AND NOT {_PROHIBITED}", "'fact' AS modality"),
    ("condition_dropped", f"({_HAD}) OR (predicate = 'alarm_trigger_condition' AND cond_op IN ('<', '>'))", f"CASE WHEN {_HAD} THEN NULL WHEN cond_op = '<' THEN '>' ELSE '<' END AS cond_op, CASE WHEN {_HAD} THEN NULL ELSE cond_raw END AS cond_raw"),
    ("entity_swapped_near_id", "entity_id IN ('component:PS-04', 'component:PS-04A', 'component:PS-40')", "CASE entity_id WHEN 'component:PS-04' THEN 'component:PS-04A' ELSE 'component:PS-04' END AS entity_id"),
]
JUDGED_SQL = rf"""{CLAIMS_SQL}, a AS (SELECT *, CAST(substr(claim_id, 2, 10) AS BIGINT) % 7 AS n, [{listed(NAMES)}][CAST(substr(entity_id, 11) AS BIGINT) % 4 + 1] AS name FROM visible WHERE NOT needs_review AND assertion_kind = 'stated'),
    b AS (SELECT *, value_type = 'quantity' AND n = 1 AS alarm, CASE WHEN predicate = 'requires_state' AND n IN (3, 5) THEN 'Do not run. ' ELSE '' END || CASE WHEN n = 2 THEN 'It' ELSE name END
        || CASE value_type WHEN 'quantity' THEN CASE n WHEN 5 THEN ' opens above ' WHEN 1 THEN ' warns below ' ELSE ' reads ' END || CAST(value AS INT) || ' bar' || CASE WHEN n = 0 THEN ' or ' || (CAST(value AS INT) + 10) || ' bar' ELSE '' END
            WHEN 'text' THEN ' stands in ' || trim(v_text) ELSE ' must be ' || lower(v_text) END
        || CASE WHEN rev_kind <> 'ver' OR doc_no % 11 = 0 THEN '' WHEN rev_hi IS NULL THEN ' on software revision ' || rev_lo || ' and later' WHEN rev_lo IS NULL THEN ' before software revision ' || rev_hi ELSE ' on software revision ' || rev_lo || ' and ' || rev_hi || ' only' END || '.' AS quote FROM a),
    said AS (SELECT claim_id, CASE WHEN alarm THEN 'alarm:E1' WHEN predicate = 'config_key_value' THEN 'config:K1' ELSE 'component:' || name END AS entity_id,
        CASE WHEN n = 6 THEN 'unheard_of' WHEN alarm THEN 'alarm_trigger_condition' WHEN value_type = 'quantity' AND n = 5 AND predicate <> 'config_key_value' THEN 'reset_pressure_limit' ELSE predicate END AS predicate,
        CASE WHEN alarm THEN 'condition' ELSE value_type END AS value_type, CASE WHEN NOT alarm THEN value END AS value, CASE WHEN NOT alarm THEN value END AS raw, CASE WHEN NOT alarm THEN unit END AS unit, trim(v_text) AS v_text,
        CASE WHEN n = 5 THEN 'fact' ELSE 'requirement' END AS modality, CASE WHEN alarm THEN '<' WHEN value_type = 'quantity' AND n = 5 THEN '>' END AS cond_op, CASE WHEN alarm OR n = 5 THEN value END AS cond_raw,
        rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, CASE WHEN rev_kind = 'ver' THEN 'explicit_cue' ELSE 'document_default' END AS basis, quote, CASE WHEN n = 4 AND value_type = 'text' THEN 'Another text.' ELSE 'Heading.  ' || quote || ' Rest.' END AS element_text FROM b),
    corrupt AS ({' UNION ALL '.join(f"SELECT '{m}' AS mutation, * {f'REPLACE ({new})' if new else ''} FROM said WHERE {applies}" for m, applies, new in _CORRUPT)}),
    read AS (SELECT *, list_transform(regexp_extract_all(quote, '-?\d+(?:\.\d+)?'), lambda x: CAST(x AS DOUBLE)) AS numbers, list_transform(regexp_extract_all(quote, '(\d+) bar', 1), lambda x: CAST(x AS DOUBLE)) AS bars,
        nullif(regexp_extract(quote, 'revision {_VERSION} and later', 1), '') AS later, nullif(regexp_extract(quote, 'before software revision {_VERSION}', 1), '') AS before,
        nullif(regexp_extract(quote, 'revision {_VERSION} and {_VERSION} only', 1), '') AS one, nullif(regexp_extract(quote, 'revision {_VERSION} and {_VERSION} only', 2), '') AS two,
        regexp_extract(quote, '(above|below) \d+', 1) AS word, TRY_CAST(regexp_extract(quote, '(above|below) (\d+)', 2) AS DOUBLE) AS bound, regexp_extract(quote, 'PS-[0-9A-Z]+') AS named FROM corrupt),
    judged AS (SELECT claim_id, mutation, CASE WHEN contains(element_text, quote) THEN 'PASS' ELSE 'FAIL' END AS v1,
        CASE WHEN value_type = 'quantity' THEN CASE WHEN list_contains(numbers, raw) AND (len(bars) = 0 OR (unit = 'bar' AND len(list_filter(bars, lambda x: abs(x - value) <= 1e-6 * greatest(1, abs(value)))) > 0)) THEN 'PASS' ELSE 'FAIL' END
            WHEN value_type = 'state' THEN CASE WHEN contains(lower(quote), lower(v_text)) THEN 'PASS' ELSE 'FAIL' END ELSE 'PASS' END AS v2,
        CASE WHEN predicate NOT IN ({listed(SELF_DESCRIBING)}) THEN 'SKIP' WHEN named = '' OR 'component:' || named = entity_id THEN 'PASS' ELSE 'FAIL' END AS v2b,
        CASE WHEN coalesce(later, before, one) IS NOT NULL AND rev_kind = 'any' THEN 'FAIL' WHEN coalesce(later, before, one) IS NULL THEN CASE WHEN basis = 'explicit_cue' THEN 'FAIL' ELSE 'PASS' END
            WHEN basis = 'explicit_cue' AND NOT coalesce(rev_lo_inc AND ((rev_lo = later AND rev_hi IS NULL AND NOT rev_hi_inc) OR (rev_hi = before AND rev_lo IS NULL AND NOT rev_hi_inc) OR (rev_lo = one AND rev_hi = two AND rev_hi_inc)), false) THEN 'FAIL' ELSE 'PASS' END AS v3,
        CASE WHEN predicate IN ({listed(ACTION)}) AND {_PROHIBITED} AND modality = 'fact' THEN 'FAIL'
            WHEN predicate IN ({listed(COMPARED)}) AND word <> '' AND NOT coalesce(cond_raw = bound AND cond_op = CASE word WHEN 'above' THEN '>' ELSE '<' END, false) THEN 'FAIL' ELSE 'PASS' END AS v4,
        CASE WHEN predicate = 'unheard_of' OR (value_type = 'quantity' AND predicate <> 'config_key_value' AND unit <> 'bar') THEN 'FAIL' ELSE 'PASS' END AS v5 FROM read)"""
_HITS = " + ".join(f"CAST({x} = 'FAIL' AS INT)" for x in mutate.LAYERS)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.judged(quoted_claims(spark, sf_dir), {n: f"component:{n}" for n in NAMES})


@query(f"""{JUDGED_SQL}, h AS (SELECT *, {_HITS} AS hits FROM judged) SELECT mutation, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (hits > 0) AS BIGINT) AS caught, {', '.join(f"CAST(count(*) FILTER ({x} = 'FAIL') AS BIGINT) AS {x}" for x in mutate.LAYERS)},
    {', '.join(f"CAST(count(*) FILTER ({x} = 'FAIL' AND hits = 1) AS BIGINT) AS only_{x}" for x in mutate.LAYERS)}, count(*) FILTER (hits > 0) / count(*) AS catch_rate FROM h GROUP BY mutation""")
def catch_rates(spark, sf_dir):
    """Eight corruptions of every claim, what each layer catches of them, and what it says of the claims as they are."""
    return mutate.catch_rates(_judged(spark, sf_dir))


@query(f"{JUDGED_SQL} SELECT claim_id, mutation, v1, v2, v2b, v3, v4, v5 FROM judged")
def corrupted_claims(spark, sf_dir):
    """The layers' results on each corrupted claim."""
    return _judged(spark, sf_dir)
