"""Inference to a fixpoint, with a row for each derivation, and what falls when claims are withdrawn.

A chain rule makes a claim of two: A `first` B and B `then` C give A `head` C where their scopes overlap, in the scope that both
share. The first claim may be inferred, so a rule whose head is a first predicate runs on until nothing new follows. Each round
joins only what the round before found; every pair of supports meets once, so all derivations are recorded, also later ones of a
known claim. An inferred claim takes document and tier of its first support and is known by its contents, so equal conclusions
are one claim with several derivations. A claim on a thing and itself is not made, so cycles of claims end.

The rules that look at what is missing or ambiguous (relate.infer_mapping, infer_tags, infer_distinct) are asked once, of the
corpus's own claims; their supports are recorded alike.

Only visible stated claims that need no review support a chain. Null ids, entities and values support nothing; a repeated row
repeats its derivations; an empty table gives empty ones. Columns that rules don't name are not looked at.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import scope
from attestor.functions.version import version_key
from attestor.functions.workers import stored
from attestor.operators import relate
from attestor.operators.relate import visible

REV = ["rev_kind", "rev_lo", "rev_hi", "rev_lo_inc", "rev_hi_inc"]
SCOPE = [*REV, "lo_k", "hi_k", "sensor_kind", "sensor_ids"]
FACT = ["claim_id", "entity_id", "predicate", "value_id", *SCOPE, "tier", "doc_id"]
DERIVATION = ["derived_id", "rule", "uses"]


@dataclass(frozen=True)
class Chain:
    name: str
    first: str
    then: str
    head: str


@dataclass(frozen=True)
class Inferred:
    """claims: FACT and assertion_kind, v_text; derivations: DERIVATION, uses being one or two claim ids in order; chains: the rules run."""

    claims: DataFrame
    derivations: DataFrame
    chains: tuple[Chain, ...]
    aliases: DataFrame | None


def _both(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _outside(rows: DataFrame, parts: list[DataFrame], on="claim_id") -> DataFrame:
    """rows whose claim is in none of the parts (claim_id)."""
    return rows.join(_both([p.select("claim_id") for p in parts]), on, "left_anti") if parts else rows


def _supports(claims: DataFrame, chains: tuple[Chain, ...]) -> DataFrame:
    named = sorted({p for c in chains for p in (c.first, c.then)})
    c = visible(claims).filter(F.col("predicate").isin(named) & ~F.col("needs_review") & (F.col("assertion_kind") == "stated"))
    return c.dropna(subset=["claim_id", "entity_id", "value_id"]).select(*FACT)


def _apply(chain: Chain, lefts: DataFrame, base: DataFrame) -> DataFrame:
    """Derivations by one rule with the claims they make: FACT, rule, uses."""
    a = lefts.filter(F.col("predicate") == chain.first).select(*[F.col(x).alias(f"a_{x}") for x in FACT])
    b = base.filter(F.col("predicate") == chain.then).select(*[F.col(x).alias(f"b_{x}") for x in FACT])
    met = a.join(b, F.col("a_value_id") == F.col("b_entity_id")).filter("a_entity_id <> b_value_id").filter(F.expr(scope.scope_relation("a_", "b_") + " = 'OVERLAP'"))
    met = met.withColumn("m", F.expr(scope.meet("a_", "b_")))
    met = met.select(
        F.col("a_entity_id").alias("entity_id"), F.lit(chain.head).alias("predicate"), F.col("b_value_id").alias("value_id"),
        *[F.col(f"m.{x.removeprefix('rev_')}").alias(x) for x in REV],
        F.expr("IF(a_sensor_kind = 'any', b_sensor_kind, a_sensor_kind)").alias("sensor_kind"),
        F.expr("array_sort(CASE WHEN a_sensor_kind = 'any' THEN b_sensor_ids WHEN b_sensor_kind = 'any' THEN a_sensor_ids ELSE array_intersect(a_sensor_ids, b_sensor_ids) END)").alias("sensor_ids"),
        F.col("a_tier").alias("tier"), F.col("a_doc_id").alias("doc_id"), F.lit(chain.name).alias("rule"), F.array("a_claim_id", "b_claim_id").alias("uses"),
    )
    told = F.concat_ws("|", F.concat(F.lit("I:"), "predicate"), "entity_id", "value_id", F.expr(scope.describe()), F.concat_ws(",", "sensor_kind", "sensor_ids"), "doc_id", "tier")
    return met.select(told.alias("claim_id"), "*", F.expr(version_key("rev_lo")).alias("lo_k"), F.expr(version_key("rev_hi")).alias("hi_k"))


def closure(claims: DataFrame, chains: tuple[Chain, ...]) -> tuple[DataFrame, DataFrame]:
    """(inferred claims, derivations) of the chain rules, semi-naive: a round for each link of the longest chain, written before the next."""
    base = stored(_supports(claims, chains), "base")
    fresh, made, found = base, [], []
    while True:
        steps = stored(_both([_apply(c, fresh, base) for c in chains]), f"round{len(made)}")
        made.append(steps)
        fresh = stored(_outside(steps.dropDuplicates(["claim_id"]).select(*FACT), found), f"new{len(made)}")
        if fresh.isEmpty():
            break
        found.append(fresh)
    return _both(found) if found else fresh, _both(made).select(F.col("claim_id").alias("derived_id"), "rule", "uses")


def _asked_once(claims: DataFrame, aliases: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(inferred claims, derivations) of the rules that no inferred claim feeds."""
    pick = ["claim_id", *SCOPE, "tier", "doc_id"]
    own = claims.select(*pick)
    parts = []
    mapped = relate.infer_mapping(claims).filter("NOT ambiguous").select("claim_id", "target")
    keys = mapped.dropna().join(claims.select("entity_id", "value", "unit", *pick), "claim_id")
    backs = relate.mapping_targets(claims).select("value", "unit", "target", F.col("claim_id").alias("b_claim_id"), *[F.col(s).alias(f"b_{s}") for s in SCOPE])
    a = keys.select("*", *[F.col(s).alias(f"a_{s}") for s in SCOPE])
    held = a.join(backs, ["value", "unit", "target"]).filter(F.expr(scope.scope_relation("a_", "b_") + " = 'OVERLAP'"))
    shape = ["entity_id", "predicate", "value_id", "v_text", "assertion_kind", *pick[1:], "rule", "start", "uses"]
    parts.append(held.select("*", F.lit("config_key_maps_to").alias("predicate"), F.lit(None).cast("string").alias("value_id"), F.col("target").alias("v_text"), F.lit("inferred").alias("assertion_kind"), F.lit("R-CFGKEY-01").alias("rule"), F.col("claim_id").alias("start"), F.array("claim_id", "b_claim_id").alias("uses")).select(*shape))
    singles = [("R-SUPERSEDED-DISTINCT", relate.infer_distinct(claims))]
    if aliases is not None:
        singles.append(("R-TAG-RESOLVE", relate.infer_tags(claims, aliases)))
    for rule, rows in singles:
        rows = rows.select("claim_id", "entity_id", "predicate", "value_id", "assertion_kind").dropna().join(own, "claim_id")
        parts.append(rows.select("*", F.lit(None).cast("string").alias("v_text"), F.lit(rule).alias("rule"), F.col("claim_id").alias("start"), F.array("claim_id").alias("uses")).select(*shape))
    rows = _both(parts).withColumn("derived_id", F.concat_ws(":", F.lit("I"), "rule", "start"))
    once = rows.dropDuplicates(["derived_id"]).select(F.col("derived_id").alias("claim_id"), "entity_id", "predicate", "value_id", *SCOPE, "tier", "doc_id", "assertion_kind", "v_text")
    return once, rows.select(*DERIVATION)


def _whole(closed: tuple[DataFrame, DataFrame], once: tuple[DataFrame, DataFrame], chains, aliases) -> Inferred:
    inferred = closed[0].withColumns({"assertion_kind": F.lit("inferred"), "v_text": F.lit(None).cast("string")})
    return Inferred(inferred.unionByName(once[0]), closed[1].unionByName(once[1]), chains, aliases)


def infer(claims: DataFrame, chains: tuple[Chain, ...] = (), keyed_aliases: DataFrame | None = None) -> Inferred:
    """All that follows from the claims. keyed_aliases is what mentions.keyed gives; without it no displayed tag is resolved."""
    if not chains:
        chains = (Chain("", "", "", ""),)  # nothing has an empty predicate
    return _whole(closure(claims, chains), _asked_once(claims, keyed_aliases), chains, keyed_aliases)


def _links(derivations: DataFrame) -> DataFrame:
    return derivations.select("derived_id", F.explode("uses").alias("used"))


def fallen(derivations: DataFrame, gone: DataFrame) -> DataFrame:
    """(claim_id): inferred claims that no derivation holds up any more once the claims in gone (claim_id) are withdrawn.

    First all that leans on them is taken down, link by link; then what a derivation out of standing claims still gives is put
    back, again link by link. Claims that only hold each other up stay down.
    """
    links = stored(_links(derivations), "links")
    down = stored(gone.select("claim_id").dropna().distinct(), "gone")
    reached, front = [down], down
    while True:
        new = links.join(front, F.col("used") == F.col("claim_id"), "left_semi").select(F.col("derived_id").alias("claim_id")).distinct()
        front = stored(_outside(new, reached), f"front{len(reached)}")
        if front.isEmpty():
            break
        reached.append(front)
    if len(reached) == 1:
        return down.limit(0)
    taken = _both(reached[1:])  # each claim once
    out = F.col("used") == F.col("claim_id")
    ways = stored(derivations.join(taken, F.col("derived_id") == F.col("claim_id"), "left_semi").select(*DERIVATION), "ways")
    waits = ways.select(*DERIVATION, F.explode("uses").alias("used"))
    barred = waits.join(down, out, "left_semi").select(*DERIVATION)
    waits = stored(waits.join(taken, out, "left_semi"), "waits")
    ways = stored(ways.join(barred, DERIVATION, "left_anti"), "open")
    back: list[DataFrame] = []
    while True:
        new = ways.join(_outside(waits, back, out), DERIVATION, "left_anti").select(F.col("derived_id").alias("claim_id")).distinct()
        new = stored(_outside(new, back), f"back{len(back)}")
        if new.isEmpty():
            break
        back.append(new)
    return _outside(taken, back)


def retract(inferred: Inferred, claims: DataFrame, gone: DataFrame) -> Inferred:
    """What infer would give without the claims in gone (claim_id), chains not walked anew: only what leaned on them is looked at.

    A withdrawn claim can also make room (a mapping is no longer ambiguous, nothing calls two components distinct any more), so
    the rules asked once are asked again, of the claims that stay.
    """
    names = [c.name for c in inferred.chains]
    chained = inferred.derivations.filter(F.col("rule").isin(names))
    dead = stored(fallen(chained, gone).select("claim_id"), "fallen").unionByName(gone.select("claim_id").dropna().distinct())
    out = F.col("used") == F.col("claim_id")
    lost = _links(chained).join(dead, out, "left_semi").select("derived_id", "used").distinct()
    broken = chained.select(*DERIVATION, F.explode("uses").alias("used")).join(lost, ["derived_id", "used"], "left_semi").select(*DERIVATION)
    kept = chained.join(broken, DERIVATION, "left_anti")
    standing = inferred.claims.join(kept.select(F.col("derived_id").alias("claim_id")), "claim_id", "left_semi").select(*FACT)
    stay = claims.join(gone.select("claim_id").dropna().distinct(), "claim_id", "left_anti")
    return _whole((standing, kept), _asked_once(stay, inferred.aliases), inferred.chains, inferred.aliases)
