"""Validation layers over claims with their quotes: PASS, FAIL or SKIP by SQL expressions, and the lifecycle they lead to.

Columns: quote, element_text, predicate, value_type, value, raw, unit, v_text, items, value_id, modality, cond_op, cond_raw, basis,
rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, raster.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import quantity, text
from attestor.operators import mentions
from attestor.operators.cues import cue_array
from attestor.plans.ontology import listed, predicate_table

ACTION = ["requires_state", "reset_pressure_limit", "alarm_required_action", "prohibited_action", "installation_restriction"]
COMPARED = ["alarm_trigger_condition", "reset_pressure_limit", "alarm_required_action"]
UNCHECKED = ["release_status", "common_name"]
#: Predicates whose subject the evidence must name; that of others is implied by context.
SELF_DESCRIBING = [
    "located_at", "last_calibrated", "performed_by", "signal_type", "calibration_reference", "supply_voltage", "lifecycle_status", "introduced_by", "is_distinct_from", "superseded_by", "supported_on",
    "installation_restriction", "corresponds_to", "requires_software_revision",
]
#: The first cell of a row's text ("header: value | ..."), its key.
ROW_KEY = r"^[^:|]+: ([^|]+) \\|"
#: What a state may be called in a quote; other states by their own name. Fixed values.
STATE_WORDS = {"OPEN": ["open"], "RESET": ["reset"], "INSTALLED": ["installed", "removed", "closed"], "within normal band": ["normal band", "normal", "sight glass band"]}
#: Comparators in words. Fixed values.
COMPARATORS = {"above": ">", "more than": ">", "beyond": ">", "exceeds": ">", "exceed": ">", "over": ">", ">": ">", "below": "<", "under": "<", "<": "<", ">=": ">=", "<=": "<="}
COMPARED_PATTERN = r"(?i)(above|below|more than|beyond|exceeds?|over|under|>=|<=|>|<)\\s*(\\d+(?:\\.\\d+)?)\\s*(?:bar|seconds?|s|V|°C)?"


def quote_exists(quote: str = "quote", element: str = "element_text") -> str:
    return f"IF(coalesce(instr({text.normalize(element)}, {text.normalize(quote)}) > 0, false), 'PASS', 'FAIL')"


#: The name in an entity id stands in the quote, by itself.
NAMED = r"coalesce(quote RLIKE concat('(?i)(?<![A-Za-z0-9])\\\\Q', substring(value_id, instr(value_id, ':') + 1), '\\\\E(?![A-Za-z0-9])'), false)"


def document_named(claims: DataFrame, elements: DataFrame) -> DataFrame:
    """claims with in_document: whether a document that the claim's value is stands by name anywhere in the claim's own document."""
    asked = claims.filter("value_id LIKE 'document:%'").select("doc_id", "value_id").distinct()
    name = F.expr("substring(value_id, 10)")
    found = asked.join(elements.select("doc_id", "text"), "doc_id").groupBy("doc_id", "value_id").agg(F.bool_or(F.contains("text", name)).alias("in_document"))
    return claims.join(found, ["doc_id", "value_id"], "left")


def value_supported(mentioned: str = "cast(array() AS array<string>)", in_document: str = "contains(element_text, substring(value_id, 10))") -> str:
    nums = r"transform(regexp_extract_all(quote, '(-?\\d+(?:\\.\\d+)?)', 1), x -> cast(x AS DOUBLE))"
    same_dim = f"filter({quantity.parse('quote')}, q -> {quantity.dimension_of('q.unit')} = {quantity.dimension_of('unit')} OR q.unit = unit)"
    number = f"(raw IS NULL OR array_contains({nums}, raw)) AND (size({same_dim}) = 0 OR exists({same_dim}, q -> {quantity.equal('value', 'q.value', 'unit', 'q.unit')}))"
    words = "CASE v_text " + " ".join(f"WHEN '{k}' THEN array({listed(v)})" for k, v in STATE_WORDS.items()) + " ELSE array(lower(v_text)) END"
    has = "instr(lower(quote), {}) > 0"
    return f"""CASE WHEN predicate IN ({listed(UNCHECKED)}) THEN 'SKIP'
        WHEN value_type = 'quantity' THEN IF({number}, 'PASS', 'FAIL')
        WHEN value_type IN ('version', 'date') THEN IF(instr(quote, v_text) > 0, 'PASS', 'FAIL')
        WHEN value_type = 'person' THEN IF({has.format("lower(element_at(split(v_text, ' '), -1))")}, 'PASS', 'FAIL')
        WHEN value_type = 'enum' THEN IF({has.format('lower(v_text)')}, 'PASS', 'FAIL')
        WHEN value_type = 'state' THEN IF(exists({words}, w -> {has.format('w')}), 'PASS', 'FAIL')
        WHEN value_type = 'procedure' THEN IF(instr(quote, element_at(split(value_id, ':'), 2)) > 0, 'PASS', 'FAIL')
        WHEN value_type = 'list' THEN IF(forall(items, i -> {has.format('lower(i)')}), 'PASS', 'FAIL')
        WHEN value_type = 'not_specified' THEN IF(quote RLIKE '(?i)null|not specified|no .* specified|not included', 'PASS', 'FAIL')
        WHEN value_type = 'entity' THEN IF(coalesce(array_contains({mentioned}, value_id) OR {NAMED} OR (value_id LIKE 'document:%' AND {in_document}), false), 'PASS', 'FAIL')
        ELSE 'PASS' END"""


def scope_faithful(cues: str = "cues") -> str:
    """The cues of the quote (array of rev structs) against the claim's scope."""
    own = "named_struct('lo', rev_lo, 'hi', rev_hi, 'lo_inc', rev_lo_inc, 'hi_inc', rev_hi_inc)"
    return f"""CASE WHEN size({cues}) > 0 AND rev_kind = 'any' THEN 'FAIL' WHEN size({cues}) > 0 AND basis = 'explicit_cue' AND NOT coalesce(array_contains({cues}, {own}), false) THEN 'FAIL'
        WHEN size({cues}) = 0 AND basis = 'explicit_cue' THEN 'FAIL' ELSE 'PASS' END"""


def condition_faithful() -> str:
    words = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in COMPARATORS.items()) + ")"
    found = f"arrays_zip(regexp_extract_all(quote, '{COMPARED_PATTERN}', 1), regexp_extract_all(quote, '{COMPARED_PATTERN}', 2))"
    fits = f"forall({found}, c -> coalesce(abs(cond_raw - cast(c.`1` AS DOUBLE)) < 1e-9D AND (cond_op = element_at({words}, lower(c.`0`)) OR (element_at({words}, lower(c.`0`)) = '<' AND cond_op = '<=')), false))"
    return rf"""CASE WHEN predicate IN ({listed(ACTION)}) AND quote RLIKE '(?i)\\b(do not|must not|never)\\b' AND modality = 'fact' THEN 'FAIL'
        WHEN predicate IN ({listed(COMPARED)}) AND NOT {fits} THEN 'FAIL' ELSE 'PASS' END"""


def types_allowed() -> str:
    """With the predicate's row joined (kinds, vtypes, dim)."""
    return f"""CASE WHEN kinds IS NULL THEN 'FAIL' WHEN NOT array_contains(kinds, element_at(split(entity_id, ':'), 1)) THEN 'FAIL' WHEN NOT array_contains(vtypes, value_type) THEN 'FAIL'
        WHEN value_type = 'quantity' AND dim IS NOT NULL AND NOT coalesce({dimension_of_unit('unit')} = dim, false) THEN 'FAIL' ELSE 'PASS' END"""


def dimension_of_unit(u: str) -> str:
    own = {unit: dim for unit, dim, _ in quantity.UNITS.values()}
    return f"CASE {u} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in own.items()) + " END"


def subject_named(claims: DataFrame, surfaces: dict[str, str]) -> DataFrame:
    """claims with v2b: the row key where it names an entity, else the quote's mentions of the subject's kind, else those of a raster region.

    surfaces is a register of names (a dimension, read once); its keys are also what row keys are looked up by.
    """
    keys = claims.sparkSession.createDataFrame(sorted({mentions.re.sub("[^A-Z0-9]", "", s.upper()): e for s, e in surfaces.items()}.items()), "row_norm string, row_entity string")
    c = mentions.find_mentions(claims, "quote", surfaces).withColumnRenamed("mentions", "in_quote")
    c = mentions.find_mentions(c.withColumn("region", F.expr("IF(raster IN ('agree', 'disagree'), element_text, NULL)")), "region", surfaces).withColumnRenamed("mentions", "in_region")
    c = c.withColumn("row_norm", F.expr(text.norm_key(f"regexp_extract(element_text, '{ROW_KEY}', 1)"))).join(F.broadcast(keys), "row_norm", "left")
    own = lambda m: f"filter(transform({m}, m -> m.entity_id), e -> split(e, ':')[0] = split(entity_id, ':')[0])"
    c = c.withColumn("named", F.expr("transform(in_quote, m -> m.entity_id)"))
    c = c.withColumns({"in_quote": F.expr(own("in_quote")), "in_region": F.expr(own("in_region"))})
    layer = f"""CASE WHEN predicate NOT IN ({listed(SELF_DESCRIBING)}) OR assertion_kind <> 'stated' THEN 'SKIP'
        WHEN row_entity IS NOT NULL THEN IF(row_entity = entity_id, 'PASS', 'FAIL')
        WHEN size(in_quote) > 0 THEN IF(array_contains(in_quote, entity_id), 'PASS', 'FAIL')
        WHEN size(in_region) > 0 THEN IF(array_contains(in_region, entity_id), 'PASS', 'FAIL') ELSE 'PASS' END"""
    return c.withColumn("v2b", F.expr(layer)).drop("in_quote", "in_region", "region", "row_norm", "row_entity")


def validate(claims: DataFrame, surfaces: dict[str, str] | None = None) -> DataFrame:
    """claims with v1..v5, raster and the new lifecycle; only PROPOSED claims change. With a register of names also v2b, its subject's layer."""
    if surfaces:
        claims = subject_named(claims, surfaces)
    c = claims.withColumn("cues", cue_array(F.expr(text.strip_parens("quote"))))
    ontology = F.broadcast(predicate_table(claims.sparkSession))  # a row for each predicate of the closed world
    c = c.join(ontology, "predicate", "left")
    of_document = {"in_document": "in_document"} if "in_document" in c.columns else {}
    c = c.withColumns({"v1": F.expr(quote_exists()), "v2": F.expr(value_supported("named" if surfaces else "cast(array() AS array<string>)", **of_document)), "v3": F.expr(scope_faithful()), "v4": F.expr(condition_faithful()), "v5": F.expr(types_allowed())})
    c = c.withColumn("v_raster", F.expr("CASE raster WHEN 'disagree' THEN 'VETO' WHEN 'agree' THEN 'PASS' ELSE 'SKIP' END"))
    new = "CASE WHEN lifecycle <> 'PROPOSED' THEN lifecycle WHEN array_contains(array(v1, v2, {v2b}v3, v4, v5), 'FAIL') THEN 'REJECTED' WHEN v_raster = 'VETO' THEN 'DEMOTED' ELSE 'ADMITTED' END"
    return c.withColumn("lifecycle", F.expr(new.format(v2b="v2b, " if surfaces else ""))).drop("kinds", "vtypes", "dim", "cues", "named", "in_document")


def audit(validated: DataFrame) -> DataFrame:
    """(claim_id, stage, result): a row for each layer."""
    n, v2b = (7, "'V2b', v2b, ") if "v2b" in validated.columns else (6, "")
    return validated.selectExpr("claim_id", f"stack({n}, 'V1', v1, 'V2', v2, {v2b}'V3', v3, 'V4', v4, 'V5', v5, 'RASTER', v_raster) AS (stage, result)")
