"""Claims corrupted in known ways, all validated in one plan: which layer catches what, and what none does.

A claim is spread into one row for each corruption that its fields allow; the quote stays as it was. Columns are those of
validate, and claim_id, assertion_kind, lifecycle and needs_review; only visible stated claims that need no review are taken.
Where a condition is unknown because of a null, a corruption does not apply.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.relate import visible
from attestor.operators.validate import ACTION, validate
from attestor.plans.ontology import listed

PROHIBITED = r"quote RLIKE '(?i)\\b(do not|must not|never)\\b'"
HALF_OPEN = "rev_kind = 'ver' AND (rev_lo IS NULL) <> (rev_hi IS NULL)"
CONDITIONED = "predicate IN ('reset_pressure_limit', 'alarm_required_action') AND cond_op IS NOT NULL"
FLIPPED = "predicate = 'alarm_trigger_condition' AND cond_op IN ('<', '>')"
#: Identifiers that are easily taken for each other. Fixed values.
NEAR = {"component:PS-04": "component:PS-04A", "component:PS-04A": "component:PS-04", "component:PS-40": "component:PS-04"}
LAYERS = ["v1", "v2", "v2b", "v3", "v4", "v5"]


def mutations(near: dict[str, str]) -> dict[str, tuple[str, dict[str, str]]]:
    """name: (SQL for the claims it applies to, {column: SQL of its new value}). near is a small fixed table of confusable ids."""
    swap = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in near.items()) + ")"
    every = {"rev_kind": "'any'", "rev_lo": "NULL", "rev_hi": "NULL", "rev_lo_inc": "true", "rev_hi_inc": "true", "basis": "'document_default'"}
    turned = {"rev_lo": "rev_hi", "rev_hi": "rev_lo", "rev_lo_inc": "true", "rev_hi_inc": "false"}
    factual = {"modality": "'fact'"}
    return {
        "scope_widened": ("basis = 'explicit_cue' AND rev_kind = 'ver'", every),
        "scope_flipped": (f"basis = 'explicit_cue' AND {HALF_OPEN}", turned),
        "value_swapped": ("value_type = 'quantity' AND predicate NOT IN ('flash_point', 'pour_point')", {"raw": "coalesce(raw, value) + 10", "value": "value + 10"}),
        "unit_swapped": ("value_type = 'quantity' AND unit = 'bar'", {"unit": "'psi'"}),
        "negation_dropped": (f"predicate IN ({listed(ACTION)}) AND modality <> 'fact' AND {PROHIBITED}", factual),
        "modality_weakened_no_cue": (f"predicate IN ({listed(ACTION)}) AND modality <> 'fact' AND NOT {PROHIBITED}", factual),
        "condition_dropped": (f"({CONDITIONED}) OR ({FLIPPED})", {"cond_op": f"CASE WHEN {CONDITIONED} THEN NULL WHEN cond_op = '<' THEN '>' ELSE '<' END", "cond_raw": f"IF({CONDITIONED}, NULL, cond_raw)"}),
        "entity_swapped_near_id": (f"element_at({swap}, entity_id) IS NOT NULL", {"entity_id": f"element_at({swap}, entity_id)"}),
    }


def mutants(claims: DataFrame, near: dict[str, str] = NEAR) -> DataFrame:
    """claims as PROPOSED, a row for each corruption that applies, and one as it is (mutation 'none')."""
    kinds = mutations(near)
    base = visible(claims).filter("NOT needs_review AND assertion_kind = 'stated'")
    names = ", ".join(f"IF(coalesce({applies}, false), '{name}', NULL)" for name, (applies, _) in kinds.items())
    spread = base.withColumn("mutation", F.explode(F.expr(f"array_compact(array('none', {names}))")))
    changed: dict[str, str] = {}
    for name, (_, new) in kinds.items():
        for column, value in new.items():
            changed[column] = changed.get(column, "") + f" WHEN '{name}' THEN {value}"
    return spread.withColumns({c: F.expr(f"CASE mutation {whens} ELSE {c} END") for c, whens in changed.items()}).withColumn("lifecycle", F.lit("PROPOSED"))


def judged(claims: DataFrame, surfaces: dict[str, str] | None = None, near: dict[str, str] = NEAR) -> DataFrame:
    """(claim_id, mutation, the layers' results): every corrupted claim, validated. Without a register of names v2b is SKIP."""
    v = validate(mutants(claims, near), surfaces)
    return (v if surfaces else v.withColumn("v2b", F.lit("SKIP"))).select("claim_id", "mutation", *LAYERS)


def catch_rates(judgements: DataFrame) -> DataFrame:
    """A row for each corruption: n, caught, those that each layer fails (one claim may fail several), only_<layer> that no other one does, and catch_rate.

    The row 'none' counts claims as they are: what is caught there is wrongly caught, or was wrong before.
    """
    fails = {x: F.col(x) == "FAIL" for x in LAYERS}
    any_of = F.lit(False)
    for f in fails.values():
        any_of = any_of | f
    hits = F.size(F.array_compact(F.array(*[F.when(f, 1) for f in fails.values()])))
    g = judgements.groupBy("mutation").agg(F.count(F.lit(1)).alias("n"), F.count_if(any_of).alias("caught"), *[F.count_if(f).alias(x) for x, f in fails.items()], *[F.count_if(f & (hits == 1)).alias(f"only_{x}") for x, f in fails.items()])
    return g.withColumn("catch_rate", F.col("caught") / F.col("n"))


def missed(judgements: DataFrame, k: int = 4) -> DataFrame:
    """(mutation, claim_id, place): the first k corrupted claims that no layer fails, by id."""
    from pyspark.sql.window import Window

    passed = judgements.filter(F.expr(" AND ".join(f"{x} <> 'FAIL'" for x in LAYERS)) & (F.col("mutation") != "none"))
    place = F.row_number().over(Window.partitionBy("mutation").orderBy("claim_id"))
    return passed.select("mutation", "claim_id", place.alias("place")).filter(F.col("place") <= k)
