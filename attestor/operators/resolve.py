"""Answering slots: candidates, the exclusion cascade, representatives, conflicts, branches and the gate, for all questions at once.

A slot is a row (question_id, slot_no, predicate, entities array<string>, system boolean, pair array<string>, op, qty, unit,
policy, required, rev_kind, rev_lo, ...): the question's scope in the same flat columns as a claim's.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import scope
from attestor.functions.workers import shuffled
from attestor.operators.relate import visible
from attestor.plans.ontology import DERIVED_SOURCE, EVENTS, FAMILY, KIND_ORDER, SINGLE_VALUED, TIER_ORDER, listed, place, policy_table

#: Slots are questions' rows, few against the claims; a batch beyond this size is shuffled like any table.
MOST_BROADCAST_SLOTS = 20_000
REV = ["rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k"]


def source_predicate(p: str) -> str:
    return f"CASE {p} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DERIVED_SOURCE.items()) + f" ELSE {p} END"


def small(slots: DataFrame, count: int | None, keyed: bool = True) -> DataFrame:
    """slots with a broadcast hint if their number is known to be small; else dealt out by their key, if that is more than a predicate."""
    if count is not None and count <= MOST_BROADCAST_SLOTS:
        return F.broadcast(slots)
    return shuffled(slots) if keyed else slots


def candidates(claims: DataFrame, slots: DataFrame, count: int | None = None, kinds: tuple[str, ...] = ("pair", "value", "system", "entity")) -> DataFrame:
    """Visible claims of each slot's predicate: by pair, by value, by system or by entity, in that order of precedence.

    Each kind is an equi-join of its own: on the two ends, on the condition, on the predicate, or on the entity. kinds:
    those that the slots can be of.
    """
    s = slots.select("question_id", "slot_no", F.col("predicate").alias("slot_predicate"), F.expr(source_predicate("predicate")).alias("s_predicate"), "entities", "system", "pair", "op", "qty", F.col("unit").alias("q_unit"), "policy", "required", *[F.col(c).alias(f"q_{c}") for c in REV])
    c = visible(claims)
    for name, kind in (("value_id", "string"), ("cond_op", "string"), ("cond_value", "double"), ("cond_unit", "string")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    is_kind = "CASE WHEN pair IS NOT NULL THEN 'pair' WHEN op IS NOT NULL THEN 'value' WHEN system THEN 'system' ELSE 'entity' END"
    s = s.withColumn("slot_kind", F.expr(is_kind))
    same = F.col("predicate") == F.col("s_predicate")
    out = None
    for kind in kinds:
        own = s.filter(F.col("slot_kind") == kind)
        if kind == "pair":
            met = c.filter("value_id IS NOT NULL").join(small(own.withColumn("ends", F.array_sort("pair")), count), same & (F.array_sort(F.array("entity_id", "value_id")) == F.col("ends"))).drop("ends")
        elif kind == "value":
            met = c.filter("cond_op IS NOT NULL").join(small(own, count), same & (F.col("cond_op") == F.col("op")) & (F.col("cond_unit") == F.col("q_unit"))).filter("abs(cond_value - qty) <= 1e-6D * greatest(1D, abs(cond_value))")
        elif kind == "system":
            met = c.join(small(own, count, keyed=False), same)
        else:
            own = own.withColumn("s_entity", F.explode(F.array_distinct("entities")))
            met = c.join(small(own, count), same & (F.col("entity_id") == F.col("s_entity"))).drop("s_entity")
        out = met if out is None else out.unionByName(met)
    return out.drop("s_predicate", "slot_kind")


def disposition(no_scope: bool = False, no_admission: bool = False) -> str:
    """SQL: applicable, supporting or excluded with its reason. The order is part of the contract."""
    rel = scope.combine(scope.rev_relation("", "q_"), "IF(sensor_kind = 'unknown', 'UNKNOWN', 'OVERLAP')")
    filtered = f"(scope_filter AND NOT predicate IN ({listed(EVENTS)}))" if not no_scope else "false"
    admission = "true" if not no_admission else "false"
    return f"""CASE WHEN value_type = 'not_specified' THEN 'excluded: not specified' WHEN needs_review THEN 'excluded: needs review'
        WHEN {filtered} AND {rel} = 'DISJOINT' THEN 'excluded: scope disjoint' WHEN {filtered} AND {rel} = 'UNKNOWN' THEN 'excluded: scope unknown'
        WHEN {admission} AND tier = 'field_observation' AND NOT array_contains(sole_tiers, 'field_observation') THEN 'excluded: field observation'
        WHEN {admission} AND NOT array_contains(allowed_kinds, assertion_kind) THEN 'supporting'
        WHEN NOT {admission} OR array_contains(sole_tiers, tier) THEN 'applicable' ELSE 'supporting' END"""


def dispose(cands: DataFrame, ablate: frozenset[str] = frozenset()) -> DataFrame:
    policies = F.broadcast(policy_table(cands.sparkSession))  # nine rows
    return cands.join(policies, "policy").withColumn("disposition", F.expr(disposition("scope" in ablate, "admissibility" in ablate)))


def advisories(claims: DataFrame, slots: DataFrame, count: int | None = None, named_only: bool = False) -> DataFrame:
    """Claims to show beside an answer: observations of the slot's family, and unverified or unscoped claims of it.

    named_only: every slot names an entity, so none is met by its predicate alone.
    """
    s = slots.select("question_id", "slot_no", F.expr(source_predicate("predicate")).alias("s_predicate"), F.explode_outer(F.array_distinct("entities")).alias("s_entity"))
    family = "CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILY.items()) + " END"
    c = visible(claims).withColumn("family", F.expr(family))
    wide = c.withColumn("as_predicate", F.expr("explode(array_distinct(array_compact(array(family, IF(needs_review OR rev_kind = 'unknown', predicate, NULL)))))"))
    same = F.col("as_predicate") == F.col("s_predicate")
    named = wide.join(small(s.filter("s_entity IS NOT NULL"), count), same & (F.col("entity_id") == F.col("s_entity")))
    free = wide.join(small(s.filter("s_entity IS NULL"), count, keyed=False), same)
    why = F.expr("CASE WHEN needs_review THEN 'needs review' WHEN tier = 'field_observation' THEN 'field observation' ELSE 'scope not established' END")
    return (named if named_only else named.unionByName(free)).select("question_id", "slot_no", "claim_id", why.alias("why"))


def representatives(disposed: DataFrame) -> DataFrame:
    """Answer-bearing representatives: (question_id, slot_no, claim columns..., n_members).

    A value that a slot has alone, or of a predicate with many values, gives one. Where a single-valued slot has several
    values, each gives one per scope text, without those that another of the same value contains.
    """
    key = ["question_id", "slot_no", "entity_id", "predicate", "item"]
    group, scopes = [*key, "vkey"], ["rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k"]
    a = disposed.filter("disposition = 'applicable'").withColumn("item", F.coalesce("item", F.lit(""))).withColumn("scope_text", F.expr(scope.describe()))
    order = F.struct(F.expr(place("assertion_kind", KIND_ORDER)), F.when(F.col("sensor_kind") == "ent", 0).otherwise(1), F.expr(place("tier", TIER_ORDER)), F.col("claim_id"))
    # dealt once by slot: the aggregates and windows below all keep that partitioning
    best = a.repartition(*key).groupBy(*group, "scope_text", *scopes).agg(F.min_by(F.struct("claim_id", "value", "unit", "value_type", "v_text", "assertion_kind", "tier", "doc_id", "sensor_kind", "sensor_ids"), order).alias("c"), F.min(order).alias("rank"), F.count(F.lit(1)).alias("n"))
    in_slot, in_group = Window.partitionBy(*key), Window.partitionBy(*group)
    best = best.withColumn("split", F.expr(f"predicate IN ({listed(SINGLE_VALUED)})") & (F.min("vkey").over(in_slot) != F.max("vkey").over(in_slot)))
    # rows are distinct scopes by now, so a group's list of scopes is short
    best = best.withColumn("n_members", F.sum("n").over(in_group)).withColumn("others", F.collect_list(F.struct(*scopes)).over(in_group))
    widest = best.filter(F.expr(f"NOT exists(others, o -> {scope.contains_strictly('o.', '')})"))
    kept = widest.groupBy(*group, F.expr("IF(split, scope_text, '')").alias("sub")).agg(F.min_by(F.struct("c", *scopes, "scope_text", "n_members"), "rank").alias("p"))
    return kept.select(*group, "p.c.*", *[F.col(f"p.{x}") for x in (*scopes, "scope_text", "n_members")])


def conflicts(disposed: DataFrame, rels: DataFrame) -> DataFrame:
    """Slots whose applicable claims conflict: (question_id, slot_no, side_a, side_b, n_pairs, docs)."""
    a = disposed.filter("disposition = 'applicable'").select("question_id", "slot_no", "claim_id", "vkey", "doc_id")
    x = a.select("question_id", "slot_no", F.col("claim_id").alias("src"), F.col("vkey").alias("v1"), F.col("doc_id").alias("d1"))
    y = a.select("question_id", "slot_no", F.col("claim_id").alias("dst"), F.col("vkey").alias("v2"), F.col("doc_id").alias("d2"))
    hit = rels.filter("kind = 'conflicts_with'").select("src", "dst").join(x, "src").join(y, ["question_id", "slot_no", "dst"])
    g = hit.groupBy("question_id", "slot_no", F.least("v1", "v2").alias("side_a"), F.greatest("v1", "v2").alias("side_b"))
    return g.agg(F.count(F.lit(1)).alias("n_pairs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("d1", "d2"))))), ",").alias("docs"))


def conflicts_within(disposed: DataFrame) -> DataFrame:
    """conflicts() with the relations of the very claims that were disposed: applicable claims meet in their slot, so no other pair is made.

    Claims alike in value, document and scope are folded before they meet, with their number.
    """
    key, sides = ["question_id", "slot_no", "entity_id", "predicate", "item"], ["vkey", "doc_id", "rev_kind", "rev_lo_inc", "rev_hi_inc", "lo_k", "hi_k", "sensor_kind", "sensor_ids"]
    a = disposed.filter(f"disposition = 'applicable' AND NOT needs_review AND predicate IN ({listed(SINGLE_VALUED)})").withColumn("item", F.coalesce("item", F.lit("")))
    alike = a.repartition(*key).groupBy(*key, *sides).agg(F.count(F.lit(1)).alias("n"))
    left, right = (alike.select(*key, *[F.col(x).alias(f"{p}_{x}") for x in [*sides, "n"]]) for p in "ab")
    hit = left.join(shuffled(right), key).filter("a_vkey < b_vkey").filter(F.expr(scope.scope_relation("a_", "b_") + " = 'OVERLAP'"))
    g = hit.groupBy("question_id", "slot_no", F.col("a_vkey").alias("side_a"), F.col("b_vkey").alias("side_b"))
    return g.agg(F.sum(F.col("a_n") * F.col("b_n")).alias("n_pairs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("a_doc_id", "b_doc_id"))))), ",").alias("docs"))


def gate(slots: DataFrame, reps: DataFrame, conflict: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """(question_id, status). derived: question_id of questions whose scope was derived (current revision, propagation) or partial."""
    covered = reps.select("question_id", "slot_no").distinct().withColumn("covered", F.lit(True))
    in_conflict = conflict.select("question_id", "slot_no").distinct().withColumn("conflicted", F.lit(True))
    branch = reps.filter(F.col("predicate").isin(*SINGLE_VALUED)).groupBy("question_id", "slot_no", "entity_id", "predicate", "item").agg(F.countDistinct("vkey").alias("n")).filter("n > 1").select("question_id", "slot_no").distinct().withColumn("branched", F.lit(True))
    s = slots.filter("required").select("question_id", "slot_no")
    for found in (covered, in_conflict, branch):
        s = s.join(shuffled(found), ["question_id", "slot_no"], "left")
    s = s.na.fill(False)
    g = s.groupBy("question_id").agg(F.bool_or("conflicted").alias("conflicted"), F.bool_and("covered").alias("all"), F.bool_or("covered").alias("some"), F.bool_or("branched").alias("branched"))
    if derived is not None:
        g = g.join(shuffled(derived.select("question_id").distinct().withColumn("narrowed", F.lit(True))), "question_id", "left").na.fill(False)
    else:
        g = g.withColumn("narrowed", F.lit(False))
    status = F.expr("CASE WHEN conflicted THEN 'CONFLICTED' WHEN all AND (branched OR narrowed) THEN 'ANSWERED_SCOPED' WHEN all THEN 'ANSWERED' WHEN some THEN 'PARTIAL' ELSE 'UNANSWERABLE' END")
    asked = slots.select("question_id").distinct()
    return asked.join(shuffled(g.select("question_id", status.alias("status"))), "question_id", "left").na.fill("UNANSWERABLE", ["status"])


def resolve(claims: DataFrame, slots: DataFrame, count: int | None = None, ablate: frozenset[str] = frozenset(), derived: DataFrame | None = None, kinds: tuple[str, ...] = ("pair", "value", "system", "entity")) -> dict[str, DataFrame]:
    """The whole resolution of a batch of slots as lazy tables."""
    disposed = dispose(candidates(claims, slots, count, kinds), ablate)
    reps, conflict = representatives(disposed), conflicts_within(disposed)
    return {"disposed": disposed, "reps": reps, "conflicts": conflict, "status": gate(slots, reps, conflict, derived), "advisories": advisories(claims, slots, count)}
