"""Relations between claims: set-based interval-overlap joins inside slots.

Every test of two claims happens inside a slot (entity, predicate, item), so a plain equi-join with a residual is enough;
Spark splits hot slots at run time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import scope, text
from attestor.plans.ontology import EVENTS, SINGLE_VALUED, listed  # noqa: F401

SLOT = ["entity_id", "predicate", "item"]
SIDE = ["claim_id", "vkey", "rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k", "sensor_kind", "sensor_ids", "doc_id", "derived_from"]


def visible(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("lifecycle").isin("ADMITTED", "DEMOTED"))


def independent(a: str = "a.", b: str = "b.") -> str:
    """SQL: different documents, neither in the other's derived_from."""
    return f"({a}doc_id <> {b}doc_id AND NOT coalesce(array_contains({a}derived_from, {b}doc_id), false) AND NOT coalesce(array_contains({b}derived_from, {a}doc_id), false))"


def slot_pairs(claims: DataFrame) -> DataFrame:
    """Pairs (a, b), a before b, of claims in one slot, with their scope relation. The null item is a slot like any other."""
    c = claims.withColumn("slot_item", F.coalesce("item", F.lit("")))
    keys = ["entity_id", "predicate", "slot_item"]
    left = c.select(*keys, *[F.col(x).alias(f"a_{x}") for x in SIDE])
    right = c.select(*keys, *[F.col(x).alias(f"b_{x}") for x in SIDE])
    pairs = left.join(right, keys).filter("a_claim_id < b_claim_id")
    return pairs.withColumn("relation", F.expr(scope.scope_relation("a_", "b_")))


def _kinds(pairs: DataFrame) -> DataFrame:
    """pairs with kinds: what the scope relation makes of two claims."""
    pairs = pairs.withColumn("same", F.expr("a_vkey = b_vkey")).withColumn("ind", F.expr(independent("a_", "b_")))
    return pairs.withColumn("kinds", F.expr(f"""CASE WHEN same AND relation = 'OVERLAP' THEN IF(NOT ind AND a_doc_id <> b_doc_id, array('corroborates', 'derived_from'), array('corroborates'))
        WHEN NOT same AND predicate IN ({listed(SINGLE_VALUED)}) AND relation = 'OVERLAP' THEN array('conflicts_with')
        WHEN NOT same AND predicate IN ({listed(SINGLE_VALUED)}) AND relation = 'DISJOINT' THEN array('version_scoped_with')
        ELSE cast(array() AS array<string>) END"""))


def relations(claims: DataFrame) -> DataFrame:
    """(kind, src, dst, independent): what follows from the scope algebra for visible claims that need no review."""
    pairs = _kinds(slot_pairs(visible(claims).filter(~F.col("needs_review"))))
    return pairs.select(F.explode("kinds").alias("kind"), F.col("a_claim_id").alias("src"), F.col("b_claim_id").alias("dst"), F.expr("ind OR NOT same").alias("independent"))


def relations_of_new(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of relations(new + old) that hold a new claim. Slots without one are not met, and old claims don't meet each other."""
    keys = ["entity_id", "predicate", "slot_item"]
    shown = lambda c: visible(c).filter(~F.col("needs_review")).withColumn("slot_item", F.coalesce("item", F.lit("")))
    fresh = shown(new)
    both = fresh.select(*keys, *SIDE, F.lit(True).alias("fresh")).unionByName(shown(old).join(fresh.select(*keys).distinct(), keys, "left_semi").select(*keys, *SIDE, F.lit(False).alias("fresh")))
    left = fresh.select(*keys, *[F.col(x).alias(f"a_{x}") for x in SIDE])
    right = both.select(*keys, *[F.col(x).alias(f"b_{x}") for x in [*SIDE, "fresh"]])
    pairs = left.join(right, keys).filter("NOT b_fresh OR a_claim_id < b_claim_id").withColumn("relation", F.expr(scope.scope_relation("a_", "b_")))
    ends = [F.least("a_claim_id", "b_claim_id").alias("src"), F.greatest("a_claim_id", "b_claim_id").alias("dst")]
    return _kinds(pairs).select(F.explode("kinds").alias("kind"), *ends, F.expr("ind OR NOT same").alias("independent"))


#: What tells claims of one slot apart where relations are concerned; bounds as versions follow from their texts.
ALIKE = ["vkey", "doc_id", "rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "sensor_kind", "sensor_ids"]


def folded(claims: DataFrame) -> DataFrame:
    """One row for all claims of a slot that are alike in value, document and scope: claim_id is the least of them, n their number."""
    c = claims.withColumn("slot_item", F.coalesce("item", F.lit("")))
    return c.groupBy("entity_id", "predicate", "slot_item", *ALIKE).agg(F.min("claim_id").alias("claim_id"), F.first("lo_k").alias("lo_k"), F.first("hi_k").alias("hi_k"), F.first("derived_from").alias("derived_from"), F.count(F.lit(1)).alias("n"))


def relation_counts(claims: DataFrame) -> DataFrame:
    """(kind, independent, n) of relations(), counted without making the pairs: alike claims meet once, with their numbers."""
    c = folded(visible(claims).filter(~F.col("needs_review")))
    keys = ["entity_id", "predicate", "slot_item"]
    left = c.select(*keys, *[F.col(x).alias(f"a_{x}") for x in [*SIDE, "n"]])
    right = c.select(*keys, *[F.col(x).alias(f"b_{x}") for x in [*SIDE, "n"]])
    pairs = left.join(right, keys).filter("a_claim_id <= b_claim_id").withColumn("relation", F.expr(scope.scope_relation("a_", "b_")))
    pairs = _kinds(pairs).withColumn("pairs", F.expr("IF(a_claim_id = b_claim_id, a_n * (a_n - 1) div 2, a_n * b_n)")).filter("pairs > 0")
    return pairs.select(F.explode("kinds").alias("kind"), F.expr("ind OR NOT same").alias("independent"), "pairs").groupBy("kind", "independent").agg(F.sum("pairs").alias("n"))


def corroboration(claims: DataFrame) -> DataFrame:
    """Per claim: other documents that state the same value in an overlapping scope, split by independence.

    Alike claims are folded before they meet, so the work follows distinct (value, document, scope) and not their copies;
    independence is a matter of the two documents alone.
    """
    c = folded(claims)
    keys = ["entity_id", "predicate", "slot_item", "vkey"]
    pick = [x for x in SIDE if x != "vkey"]
    left = c.select(*keys, *[F.col(x).alias(f"a_{x}") for x in pick])
    right = c.select(*keys, *[F.col(x).alias(f"b_{x}") for x in pick])
    met = left.join(right, keys).filter("a_doc_id <> b_doc_id").filter(F.expr(scope.scope_relation("a_", "b_") + " = 'OVERLAP'"))
    first = met.groupBy(F.col("a_claim_id").alias("least_id"), "b_doc_id").agg(F.bool_and(F.expr(independent("a_", "b_"))).alias("ind"))
    per = first.groupBy("least_id").agg(F.count_if("ind").alias("n_independent"), F.count_if(~F.col("ind")).alias("n_derived"))
    group = c.join(per, F.col("claim_id") == F.col("least_id")).select("entity_id", "predicate", "slot_item", *ALIKE, "n_independent", "n_derived")
    slot_item = F.coalesce(claims["item"], F.lit(""))
    on = [claims["entity_id"] == group["entity_id"], claims["predicate"] == group["predicate"], slot_item == group["slot_item"], *[claims[x].eqNullSafe(group[x]) for x in ALIKE]]
    return claims.join(group, on).select("claim_id", "n_independent", "n_derived")


MAPPED = ("normal_operating_pressure", "alarm_trigger_condition", "reset_pressure_limit")


def mapping_targets(claims: DataFrame, map_predicates=MAPPED) -> DataFrame:
    """Stated quantities that a config value may stand for, with target; a condition's bound counts as its value."""
    stated = visible(claims).filter(F.col("predicate").isin(*map_predicates) & (F.col("assertion_kind") == "stated") & ~F.col("needs_review"))
    if "cond_value" in stated.columns:
        bound = F.col("value_type") == "condition"
        stated = stated.withColumn("value", F.when(bound, F.col("cond_value")).otherwise(F.col("value"))).withColumn("unit", F.when(bound, F.col("cond_unit")).otherwise(F.col("unit")))
    stated = stated.filter(F.col("value_type").isin("quantity", "condition") & F.col("value").isNotNull())
    return stated.withColumn("target", F.concat_ws(" of ", "predicate", "entity_id"))


def infer_mapping(claims: DataFrame, map_predicates=MAPPED) -> DataFrame:
    """Config values that equal stated values in an overlapping scope: (claim_id, target, ambiguous); target where there is just one.

    Both sides are folded to distinct (value, unit, scope) before they meet, the stated ones with their least and greatest
    target: the work follows the distinct scopes, not the product of the claims.
    """
    scopes = ["rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k", "sensor_kind", "sensor_ids"]
    v = visible(claims)
    keys = v.filter("predicate = 'config_key_value' AND value_type = 'quantity'")
    stated = mapping_targets(claims, map_predicates)
    b = stated.groupBy("value", "unit", *[F.col(s).alias(f"b_{s}") for s in scopes]).agg(F.min("target").alias("low"), F.max("target").alias("high"))
    a = keys.select("value", "unit", *[F.col(s).alias(f"a_{s}") for s in scopes]).distinct()
    met = a.join(b, ["value", "unit"]).filter(F.expr(scope.scope_relation("a_", "b_") + " = 'OVERLAP'"))
    per = met.groupBy("value", "unit", *[f"a_{s}" for s in scopes]).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    on = [keys["value"] == per["value"], keys["unit"] == per["unit"], *[keys[s].eqNullSafe(per[f"a_{s}"]) for s in scopes]]
    return keys.join(per, on).select("claim_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("target"), (F.col("low") != F.col("high")).alias("ambiguous"))


#: How a displayed tag may have been resolved. Fixed values.
RESOLVED = ["exact", "normalized", "register", "glossary", "doc_stated"]


def infer_tags(claims: DataFrame, keyed_aliases: DataFrame) -> DataFrame:
    """Displayed tags that a name resolves (R-TAG-RESOLVE): (claim_id, entity_id, predicate, value_id, resolution, assertion_kind).

    keyed_aliases is what mentions.keyed gives. The status is that of the surface seen: the entity's own name, exact or
    normalized, else the tier of the alias.
    """
    tags = visible(claims).filter("predicate = 'displays_tag' AND NOT needs_review").select("claim_id", "entity_id", "v_text", F.expr(text.norm_key("v_text")).alias("norm_key"))
    first = keyed_aliases.filter("status <> 'rejected'").groupBy("norm_key").agg(F.min_by(F.struct(F.col("entity_id").alias("value_id"), F.col("status").alias("tier")), F.struct("entity_id", "status")).alias("a"))
    name = "substring_index(value_id, ':', -1)"
    status = f"CASE WHEN trim(v_text) = {name} THEN 'exact' WHEN norm_key = {text.norm_key(name)} THEN 'normalized' ELSE tier END"
    found = tags.join(first.select("norm_key", "a.*"), "norm_key").withColumn("resolution", F.expr(status)).filter(F.col("resolution").isin(*RESOLVED))
    return found.select("claim_id", "entity_id", F.lit("matches_entity").alias("predicate"), "value_id", "resolution", F.lit("structural").alias("assertion_kind"))


def infer_distinct(claims: DataFrame) -> DataFrame:
    """Stated supersessions whose two components no visible claim calls distinct yet (R-SUPERSEDED-DISTINCT): a row for each, the new
    component its subject. (claim_id, entity_id, predicate, value_id, assertion_kind)."""
    pair = [F.least("entity_id", "value_id").alias("one"), F.greatest("entity_id", "value_id").alias("two")]
    v = visible(claims).filter("value_id IS NOT NULL")
    known = v.filter("predicate = 'is_distinct_from'").select(*pair)
    stated = v.filter("predicate = 'superseded_by' AND NOT needs_review AND assertion_kind = 'stated'").select("*", *pair)
    new = stated.join(known, ["one", "two"], "left_anti")
    return new.select("claim_id", F.col("value_id").alias("entity_id"), F.lit("is_distinct_from").alias("predicate"), F.col("entity_id").alias("value_id"), F.lit("inferred").alias("assertion_kind"))


def dual_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """(claim_id, reader, outcome, lifecycle): the second reader's claims against the first's, and what becomes of both.

    Difference wins: both sides of a disagreement are demoted. A second claim that agrees is rejected as a copy and the
    first one is confirmed; one without a counterpart is demoted. First claims that none meets are not returned.
    """
    pick = [x for x in SIDE if x not in ("doc_id", "derived_from")]
    c = lambda d, p: d.select("entity_id", "predicate", F.coalesce("item", F.lit("")).alias(f"{p}item"), *[F.col(x).alias(f"{p}{x}") for x in pick], *([F.col("lifecycle").alias("b_lifecycle")] if p == "b_" else []))
    j = c(other, "a_").join(c(one, "b_"), ["entity_id", "predicate"], "left")
    over = F.expr(f"b_claim_id IS NOT NULL AND {scope.scope_relation('a_', 'b_')} = 'OVERLAP'")
    differs = F.coalesce(over & F.expr(f"a_vkey <> b_vkey AND predicate IN ({listed(SINGLE_VALUED)}) AND a_item = b_item"), F.lit(False))
    j = j.withColumn("differs", differs).withColumn("equals", F.coalesce(over & F.expr("a_vkey = b_vkey"), F.lit(False)))
    second = j.groupBy(F.col("a_claim_id").alias("claim_id")).agg(F.bool_or("differs").alias("diff"), F.bool_or("equals").alias("eq"))
    first = j.filter("differs OR equals").groupBy(F.col("b_claim_id").alias("claim_id"), "b_lifecycle").agg(F.bool_or("differs").alias("diff"))
    second = second.selectExpr("claim_id", "'second' AS reader", "CASE WHEN diff THEN 'disagree' WHEN eq THEN 'agree' ELSE 'unconfirmed' END AS outcome", "IF(NOT diff AND eq, 'REJECTED', 'DEMOTED') AS lifecycle")
    return second.unionByName(first.selectExpr("claim_id", "'first' AS reader", "IF(diff, 'disagree', 'agree') AS outcome", "IF(diff, 'DEMOTED', b_lifecycle) AS lifecycle"))


def maximal(claims: DataFrame, group: list[str]) -> DataFrame:
    """Claims of each group that no other one's revision scope strictly contains; all of them where none is left.

    Groups are compared by distinct scopes, so equal scopes meet once.
    """
    scopes = ["rev_kind", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k"]
    distinct = claims.select(*group, *scopes).distinct()
    a = distinct.select(*group, *[F.col(s).alias(f"a_{s}") for s in scopes])
    b = distinct.select(*[F.col(g).alias(f"g_{g}") for g in group], *[F.col(s).alias(f"b_{s}") for s in scopes])
    inside = F.expr(" AND ".join(f"{g} <=> g_{g}" for g in group) + f" AND {scope.contains_strictly('b_', 'a_')}")
    kept = a.join(b, inside, "left_anti")
    on = [claims[g].eqNullSafe(kept[g]) for g in group] + [claims[s].eqNullSafe(kept[f"a_{s}"]) for s in scopes]
    return claims.join(kept, on, "left_semi")


def representatives(claims: DataFrame) -> DataFrame:
    """One claim per (slot, value): the first of the widest by kind, sensor, tier and id."""
    from attestor.plans.ontology import KIND_ORDER, TIER_ORDER, place

    group = ["entity_id", "predicate", "item", "vkey"]
    order = F.struct(F.expr(place("assertion_kind", KIND_ORDER)), F.when(F.col("sensor_kind") == "ent", 0).otherwise(1), F.expr(place("tier", TIER_ORDER)), F.col("claim_id"))
    return maximal(claims, group).groupBy(*group).agg(F.min_by("claim_id", order).alias("claim_id"), F.count(F.lit(1)).alias("n_widest"))


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")
