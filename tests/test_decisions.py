"""Decisions, the contract of an answer, and what stands behind it."""

import re

import pytest
from attestor.functions.workers import stored
from attestor.operators import decisions, provenance, relate, resolve
from attestor.plans import synthetic_queries, testbed

SF = "/root/testdata/sf0.001"
STATUS, SELECTED = "question_id long, status string", "question_id long, claim_id string, allowed array<string>, quoted boolean"
SENTENCES = "question_id long, kind string, text string, claim_ids array<string>, decision_nos array<int>"
DECIDED = "question_id long, decision_no int, kind string, slot_no int, subject string, text string"
GOOD = {
    "status": ("ANSWERED",), "selected": [("C1", ["q:200.0:bar", "component:PS-04"], True)],
    "said": [("SOURCE", "PS-04 reads 200 bar.", ["C1"], []), ("DERIVED", "No approver was found.", [], [1])], "decided": [(1, "GAP", 0, "approver", "No approver was found.")], "barred": [(180.0, "bar")],
}


def broken(spark, **change):
    a = GOOD | change
    one = lambda rows: [(1, *r) for r in rows]
    made = decisions.contract(
        spark.createDataFrame([(1, *a["status"])], STATUS), spark.createDataFrame(one(a["selected"]), SELECTED), spark.createDataFrame(one(a["said"]), SENTENCES),
        spark.createDataFrame(one(a["decided"]), DECIDED), spark.createDataFrame(one(a["barred"]), "question_id long, value double, unit string"),
    )
    return {(r["failure"], r["detail"]) for r in made.collect()}


def test_an_answer_that_keeps_the_contract(spark):
    assert broken(spark) == set()


@pytest.mark.parametrize(
    ("change", "failure"),
    [
        ({"said": [("SOURCE", "PS-04 reads 200 bar.", [], []), GOOD["said"][1]]}, ("claim selected but not cited", "C1")),
        ({"said": [("SOURCE", "PS-04 reads 200 bar.", ["C1", "C2"], []), GOOD["said"][1]]}, ("claim cited but not selected", "C2")),
        ({"said": [GOOD["said"][0]]}, ("decision not stated", "approver")),
        ({"said": [GOOD["said"][0], ("DERIVED", "?", [], [1, 7])]}, ("decision not of this answer", "7")),
        ({"said": [("SOURCE", "PS-04 reads 201 bar.", ["C1"], []), GOOD["said"][1]]}, ("number without a source", "201")),
        ({"said": [("SOURCE", "PS-04 reads 200 bar, once 180.", ["C1"], []), GOOD["said"][1]], "selected": [("C1", ["200", "180", "04"], True)]}, ("value of another scope", "180")),
        ({"selected": [("C1", ["200.0", "04"], False)]}, ("quote not in its source", "C1")),
        ({"status": ("UNANSWERABLE",)}, ("unanswerable but stated", "UNANSWERABLE")),
        ({"status": ("PARTIAL",), "decided": [(1, "NOTE", 0, "x", "y")]}, ("partial without a gap", "PARTIAL")),
    ],
)
def test_each_breach_is_named(spark, change, failure):
    assert broken(spark, **change) == {failure}


def test_decisions_are_ordered_and_told_once(spark):
    slots = spark.createDataFrame([(1, 0, "mtbf", False, True, "3.2", None), (1, 1, "approver", True, False, None, None), (1, 2, "located_at", False, False, None, None)], "question_id long, slot_no int, predicate string, unresolved boolean, narrowed boolean, rev_lo string, rev_hi string")
    reps = spark.createDataFrame([(1, 2, "C1", "inferred")], "question_id long, slot_no int, claim_id string, assertion_kind string")
    sides = spark.createDataFrame([(1, 2, "a", "b", "d1,d2")], "question_id long, slot_no int, side_a string, side_b string, docs string")
    beside = spark.createDataFrame([(1, 2, "C9", "needs review"), (1, 0, "C9", "needs review")], "question_id long, slot_no int, claim_id string, why string")
    got = decisions.decisions(slots, reps, sides, beside, spark.createDataFrame([(2,)], "question_id long")).orderBy("question_id", "decision_no").collect()
    assert [(r["question_id"], r["decision_no"], r["kind"], r["slot_no"], r["subject"]) for r in got] == [
        (1, 1, "SCOPE_ASSUMPTION", 0, "3.2.."), (1, 2, "FALSE_PREMISE", 1, "approver"), (1, 3, "CONFLICT", 2, "a | b"), (1, 4, "GAP", 0, "mtbf"), (1, 5, "INFERRED", 2, "C1"), (1, 6, "ADVISORY", 0, "C9"), (2, 1, "NOTE", None, "unmapped"),
    ]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_are_dealt_out_once_and_without_their_sentences(spark):
    slots = spark.createDataFrame([(1, 0, "mtbf", None, None), (1, 1, "approver", None, None)], "question_id long, slot_no int, predicate string, rev_lo string, rev_hi string")
    reps = spark.createDataFrame([(1, 1, "C1", "inferred")], "question_id long, slot_no int, claim_id string, assertion_kind string")
    sides = spark.createDataFrame([(1, 1, "a", "b", "d1,d2")], "question_id long, slot_no int, side_a string, side_b string, docs string")
    beside = spark.createDataFrame([(1, 1, "C9", "needs review"), (1, 0, "C9", "needs review")], "question_id long, slot_no int, claim_id string, why string")
    made = decisions.decisions(slots, reps, sides, beside)
    plan = plan_of(made)
    assert len(re.findall(r"hashpartitioning\(question_id#\d+L?, \d+\)", plan)) == 1 and "SortAggregate" not in plan
    assert "Unverified" not in plan_of(made.drop("text"))
    assert [r["text"] for r in made.orderBy("decision_no").collect()] == [
        "Sources disagree: a against b (d1,d2) in an overlapping scope; neither is selected.", "No mean time between failures was found in the documents searched.",
        "This is an inference (C1); no document states it directly.", "Unverified: C9 (needs review); it is not used in this answer.",
    ]


def test_the_contract_joins_decisions_only(spark):
    rows = lambda columns, *values: spark.createDataFrame([(1, *v) for v in values], f"question_id long, {columns}")
    selected, said, decided = rows("claim_id string, allowed array<string>, quoted boolean", (None, ["7"], None)), rows("kind string, text string, claim_ids array<string>, decision_nos array<int>", ("SOURCE", "7", [None], [2, 2])), rows("decision_no int, kind string, slot_no int, subject string, text string", (1, "NOTE", 0, "n", "t"), (2, "GAP", 0, "g", "t"))
    made = decisions.contract(rows("status string", ("PARTIAL",)), selected, said, decided, rows("value double, unit string", (None, "bar")))
    assert plan_of(made).count("SortMergeJoin") == 4
    assert sorted((r["failure"], r["detail"]) for r in made.collect()) == [("claim cited but not selected", None), ("claim selected but not cited", None)]  # a null is no claim's id


def test_steps_of_a_named_procedure_come_along(spark):
    cols = "claim_id string, entity_id string, predicate string, value_type string, value_id string, vkey string, tier string, lifecycle string, needs_review boolean, rev_kind string, rev_lo string, rev_hi string, rev_lo_inc boolean, rev_hi_inc boolean"
    row = lambda i, e, p, t, v, tier="primary", review=False: (i, e, p, t, v, f"{p}{v}", tier, "ADMITTED", review, "any", None, None, True, False)
    claims = spark.createDataFrame([
        row("C1", "alarm:A17", "alarm_required_action", "procedure", "procedure:7.2"), row("C2", "procedure:7.2", "procedure_steps", "list", None), row("C3", "procedure:7.2", "procedure_steps", "list", None),
        row("C4", "component:A", "superseded_by", "entity", "component:B"), row("C5", "component:A", "supported_on", "text", None), row("C6", "component:B", "installation_restriction", "text", None, "field_observation"), row("C7", "component:B", "supported_on", "text", None, review=True),
    ], cols)
    reps = spark.createDataFrame([(1, "C1")], "question_id long, claim_id string")
    slots = spark.createDataFrame([(2, "IDENTITY", ["component:B", "component:A"]), (3, "IDENTITY", ["component:B", "component:C"]), (4, "PARAMETER", None)], "question_id long, policy string, pair array<string>")
    got = {tuple(r) for r in provenance.expansions(reps, slots, claims).collect()}
    assert got == {(1, "C2", "procedure steps"), (2, "C4", "identity"), (2, "C5", "identity")}


@pytest.mark.parametrize("query", ["answer_gate", "decisions", "contract_checks"])
def test_what_grows_with_the_questions_is_never_sent_whole_to_all_tasks(spark, query):
    plan = synthetic_queries.QUERIES[query](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sent = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "o_orderkey" not in x]  # the test bed's own join of two plain tables
    assert "SortMergeJoin" in plan and not sent


def test_slots_of_unknown_number_are_dealt_out(spark):
    slots = synthetic_queries.slots_of_parts(spark, SF)
    met = resolve.candidates(testbed.claims(spark, SF), slots, kinds=("entity",))
    assert "[s_predicate" not in "".join(x for x in met._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x)
    beside = resolve.advisories(testbed.claims(spark, SF), slots, named_only=True)
    assert "[s_predicate" not in "".join(x for x in beside._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x)


def test_conflicts_of_a_slot_are_those_of_all_relations(spark):
    claims = testbed.claims(spark, SF)
    disposed = stored(resolve.dispose(resolve.candidates(claims, synthetic_queries.slots_of_parts(spark, SF), kinds=("entity",))), "disposed")
    rows = lambda df: sorted(map(tuple, df.select("question_id", "slot_no", "side_a", "side_b", "n_pairs", "docs").collect()))
    got = rows(resolve.conflicts_within(disposed))
    assert got and got == rows(resolve.conflicts(disposed, relate.relations(claims)))
