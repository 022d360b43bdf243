"""Corrupted claims and what validation catches of them."""

import pytest
from attestor.functions.workers import prepare
from attestor.operators import mutate

COLS = (
    "claim_id string, entity_id string, predicate string, value_type string, value double, raw double, unit string, v_text string, items array<string>, value_id string, modality string, cond_op string, cond_raw double, "
    "rev_kind string, rev_lo string, rev_hi string, rev_lo_inc boolean, rev_hi_inc boolean, basis string, raster string, quote string, element_text string, lifecycle string, needs_review boolean, assertion_kind string"
)
NAMES = {"PS-04": "component:PS-04", "PS-04A": "component:PS-04A"}


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def claim(cid, quote, **over):
    row = dict(claim_id=cid, entity_id="component:PS-04", predicate="normal_operating_pressure", value_type="quantity", value=180.0, raw=180.0, unit="bar", v_text=None, items=None, value_id=None, modality="fact", cond_op=None, cond_raw=None,
               rev_kind="any", rev_lo=None, rev_hi=None, rev_lo_inc=True, rev_hi_inc=False, basis="document_default", raster="n/a", quote=quote, element_text=quote, lifecycle="ADMITTED", needs_review=False, assertion_kind="stated")
    return tuple((row | over).values())


def verdicts(spark, rows, surfaces=NAMES):
    judged = mutate.judged(spark.createDataFrame(rows, COLS), surfaces)
    return {(r["claim_id"], r["mutation"]): {x for x in mutate.LAYERS if r[x] == "FAIL"} for r in judged.collect()}


def test_each_corruption_meets_its_layer(spark):
    since = dict(rev_kind="ver", rev_lo="3.2", basis="explicit_cue")
    rows = [claim("q", "PS-04 runs at 180 bar on software revision 3.2 and later.", **since),
            claim("below", "PS-04 runs at 180 bar before revision 3.2.", rev_kind="ver", rev_hi="3.2", basis="explicit_cue"),
            claim("ban", "Do not install PS-04 on old units.", predicate="installation_restriction", value_type="text", value=None, raw=None, unit=None, v_text="old units", modality="prohibition"),
            claim("rule", "Install PS-04 on new units only.", predicate="installation_restriction", value_type="text", value=None, raw=None, unit=None, v_text="new units", modality="requirement"),
            claim("reset", "Reset PS-04 below 20 bar.", predicate="reset_pressure_limit", value=20.0, raw=20.0, cond_op="<", cond_raw=20.0),
            claim("alarm", "A warns above 20 bar.", entity_id="alarm:A", predicate="alarm_trigger_condition", value_type="condition", value=None, raw=None, unit=None, cond_op=">", cond_raw=20.0),
            claim("where", "PS-04 stands in Zone 2.", predicate="located_at", value_type="text", value=None, raw=None, unit=None, v_text="Zone 2")]
    got = verdicts(spark, rows)
    assert not any(fails for (_, m), fails in got.items() if m == "none")
    assert got[("q", "scope_widened")] == got[("q", "scope_flipped")] == got[("below", "scope_flipped")] == {"v3"}
    assert got[("q", "value_swapped")] == {"v2"} and got[("q", "unit_swapped")] == {"v2", "v5"}
    assert got[("ban", "negation_dropped")] == {"v4"} and got[("rule", "modality_weakened_no_cue")] == set()
    assert got[("reset", "condition_dropped")] == got[("alarm", "condition_dropped")] == {"v4"}
    assert got[("where", "entity_swapped_near_id")] == {"v2b"} and got[("q", "entity_swapped_near_id")] == set()  # a pressure's subject may come from context
    assert ("ban", "modality_weakened_no_cue") not in got and ("rule", "negation_dropped") not in got and ("alarm", "entity_swapped_near_id") not in got


def test_what_takes_part_and_what_is_counted(spark):
    rows = [claim("b", "It is 180 bar or 190 bar."), claim("a", "It is 180 bar or 190 bar."), claim("off", "180 bar", lifecycle="REJECTED"), claim("look", "180 bar", needs_review=True), claim("inf", "180 bar", assertion_kind="inferred"),
            claim("null", None, entity_id=None, predicate=None, value_type=None, value=None, unit=None, modality=None, basis=None, rev_kind=None), claim(None, "It is 180 bar.", entity_id="component:X")]
    judged = mutate.judged(spark.createDataFrame(rows, COLS))
    assert {r["claim_id"] for r in judged.select("claim_id").collect()} == {"a", "b", "null", None}
    assert {(r["claim_id"], r["mutation"]) for r in judged.filter("claim_id = 'null'").collect()} == {("null", "none")}
    rates = {r["mutation"]: r for r in mutate.catch_rates(judged).collect()}
    assert (rates["value_swapped"]["n"], rates["value_swapped"]["caught"], rates["value_swapped"]["only_v2"]) == (3, 1, 1)
    assert rates["none"]["n"] == 4 and rates["none"]["v1"] == 1 and rates["unit_swapped"]["catch_rate"] == 1.0
    assert [(r["mutation"], r["claim_id"]) for r in mutate.missed(judged, 1).orderBy("mutation").collect()] == [("entity_swapped_near_id", "a"), ("value_swapped", "a")]
    empty = mutate.judged(spark.createDataFrame([], COLS))
    assert mutate.catch_rates(empty).count() == 0 == mutate.missed(empty).count()
