"""Inference to a fixpoint, its derivations, and what falls with withdrawn claims."""

import random

import pytest
from attestor.functions import scope
from attestor.functions.version import version_key
from attestor.functions.workers import prepare
from attestor.operators import derive, mentions
from pyspark.sql import functions as F

CHAIN = (derive.Chain("R-CHAIN", "superseded_by", "superseded_by", "superseded_by"), derive.Chain("R-PLACE", "superseded_by", "supported_on", "supported_on"))
COLS = (
    "claim_id string, entity_id string, predicate string, value_id string, v_text string, value_type string, value double, unit string, lifecycle string, needs_review boolean, assertion_kind string, "
    "rev_kind string, rev_lo string, rev_hi string, rev_lo_inc boolean, rev_hi_inc boolean, sensor_kind string, sensor_ids array<string>, tier string, doc_id string, derived_from array<string>"
)


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def claim(cid, entity, predicate, value_id=None, lo=None, hi=None, **over):
    row = dict(claim_id=cid, entity_id=entity, predicate=predicate, value_id=value_id, v_text=None, value_type="entity", value=None, unit=None, lifecycle="ADMITTED", needs_review=False, assertion_kind="stated",
               rev_kind="ver" if lo or hi else "any", rev_lo=lo, rev_hi=hi, rev_lo_inc=True, rev_hi_inc=False, sensor_kind="any", sensor_ids=[], tier="primary", doc_id="d1", derived_from=[])
    return tuple((row | over).values())


def table(spark, rows):
    c = spark.createDataFrame(rows, COLS)
    return c.withColumn("lo_k", F.expr(version_key("rev_lo"))).withColumn("hi_k", F.expr(version_key("rev_hi")))


def shown(result):
    d = sorted((r["derived_id"], r["rule"], tuple(r["uses"])) for r in result.derivations.collect())
    c = sorted((r["claim_id"], r["entity_id"], r["predicate"], r["value_id"], r["v_text"], r["scope"], r["tier"], r["doc_id"], r["assertion_kind"]) for r in result.claims.withColumn("scope", F.expr(scope.describe())).collect())
    return c, d


def test_chains_meet_scopes_to_the_end(spark):
    rows = [claim("a", "c:A", "superseded_by", "c:B", lo="1.2", tier="reference", doc_id="d7"), claim("b", "c:B", "superseded_by", "c:C", hi="2.0"), claim("b2", "c:B", "superseded_by", "c:C", hi="1.1"),
            claim("c", "c:C", "superseded_by", "c:D", sensor_kind="ent", sensor_ids=["c:S"]), claim("p", "c:D", "supported_on", "c:P"), claim("x", "c:D", "superseded_by", "c:E", needs_review=True), claim("n", None, "superseded_by", "c:A")]
    got, made = shown(derive.infer(table(spark, rows), CHAIN))
    chained = {(e, v): (s, t, d) for _, e, p, v, _, s, t, d, _ in got if p == "superseded_by"}
    assert chained[("c:A", "c:C")] == ("[1.2, 2.0)", "reference", "d7") and chained[("c:A", "c:D")] == ("[1.2, 2.0)", "reference", "d7")  # b2 lies outside a's versions
    assert set(chained) == {("c:A", "c:C"), ("c:A", "c:D"), ("c:B", "c:D")}
    assert {e for _, e, p, v, *_ in got if p == "supported_on" and v == "c:P"} == {"c:A", "c:B", "c:C"}
    assert sum(rule == "R-SUPERSEDED-DISTINCT" for _, rule, _ in made) == 4
    assert all(len(uses) in (1, 2) for *_, uses in made)


def test_withdrawal_equals_a_new_start(spark):
    rng = random.Random(5)
    rows = [claim(f"k{i:02}", f"c:{rng.randrange(7)}", rng.choice(["superseded_by", "superseded_by", "supported_on"]), f"c:{rng.randrange(7)}", lo=rng.choice([None, "1.0"]), hi=rng.choice([None, "2.0"]), doc_id=f"d{i % 2}") for i in range(16)]
    c = table(spark, rows)
    whole = derive.infer(c, CHAIN)
    gone = spark.createDataFrame([("k03",), ("k08",), ("unheard of",), (None,)], "claim_id string")
    stay = c.join(gone, "claim_id", "left_anti")
    assert len(shown(whole)[1]) > len(shown(derive.infer(stay, CHAIN))[1]) > 0
    assert shown(derive.retract(whole, c, gone)) == shown(derive.infer(stay, CHAIN))


def test_claims_that_only_hold_each_other_up_fall(spark):
    ways = [("I1", "r", ["a", "b"]), ("I2", "r", ["I1", "b"]), ("I1", "r", ["I2", "b"]), ("I3", "r", ["I2", "b"]), ("I3", "r", ["c", "b"]), ("I4", "r", ["I3", "b"]), ("I5", "r", ["c", "b"])]
    d = spark.createDataFrame(ways, "derived_id string, rule string, uses array<string>")
    down = lambda *ids: sorted(r[0] for r in derive.fallen(d, spark.createDataFrame([(i,) for i in ids], "claim_id string")).collect())
    assert down("a") == ["I1", "I2"]  # I3 stands on c, and I4 on it
    assert down("c") == ["I5"]
    assert down("a", "c") == ["I1", "I2", "I3", "I4", "I5"] and down("b") == ["I1", "I2", "I3", "I4", "I5"] and down("nothing") == []


def test_a_withdrawn_claim_can_make_room(spark):
    q = dict(value_type="quantity", value=180.0, unit="bar")
    rows = [claim("k", "cfg:K", "config_key_value", **q, tier="derived", doc_id="d9", lo="1.0"), claim("p", "c:P", "normal_operating_pressure", **q), claim("p2", "c:P", "normal_operating_pressure", **q, hi="3.0"), claim("r", "c:R", "reset_pressure_limit", **q),
            claim("s", "c:A", "superseded_by", "c:B"), claim("x", "c:B", "is_distinct_from", "c:A"), claim("t", "screen:S", "displays_tag", v_text="PS-04", value_type="text")]
    c = table(spark, rows)
    aliases = mentions.keyed(spark.createDataFrame([("component:PS-04", "PS-04", "register")], "entity_id string, surface string, status string"))
    first = derive.infer(c, keyed_aliases=aliases)
    assert shown(first)[1] == [("I:R-TAG-RESOLVE:t", "R-TAG-RESOLVE", ("t",))]
    gone = spark.createDataFrame([("r",), ("x",)], "claim_id string")
    got, made = shown(derive.retract(first, c, gone))
    assert made == [("I:R-CFGKEY-01:k", "R-CFGKEY-01", ("k", "p")), ("I:R-CFGKEY-01:k", "R-CFGKEY-01", ("k", "p2")), ("I:R-SUPERSEDED-DISTINCT:s", "R-SUPERSEDED-DISTINCT", ("s",)), ("I:R-TAG-RESOLVE:t", "R-TAG-RESOLVE", ("t",))]
    assert got[0] == ("I:R-CFGKEY-01:k", "cfg:K", "config_key_maps_to", None, "normal_operating_pressure of c:P", "≥1.0", "derived", "d9", "inferred")


def test_nothing_follows_from_nothing(spark):
    empty = table(spark, []).withColumn("more", F.lit(1))
    assert shown(derive.infer(empty, CHAIN)) == ([], []) == shown(derive.retract(derive.infer(empty, CHAIN), empty, empty.select("claim_id")))
