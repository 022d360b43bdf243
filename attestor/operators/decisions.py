"""What an answer has to disclose, as ordered rows, and the contract between decisions, claims and sentences."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions.workers import shuffled
from attestor.operators.answer import IN_WORDS, words_for
from attestor.plans.ontology import place

#: Kinds in the order in which an answer states them. Fixed values.
KINDS = ["SCOPE_ASSUMPTION", "FALSE_PREMISE", "CONFLICT", "GAP", "NOTE", "INFERRED", "COMPLETENESS", "ADVISORY"]
NUMBER = r"\d+(?:\.\d+)*"
COLUMNS = ["question_id", "kind", "slot_no", "subject", "text"]


def _rows(df: DataFrame, kind: str, subject: str, text: str = "NULL", detail: str = "NULL") -> DataFrame:
    columns = [F.expr(x).cast("string").alias(name) for x, name in ((subject, "subject"), (text, "text"), (detail, "detail"))]
    return df.select("question_id", F.lit(kind).alias("kind"), F.col("slot_no").cast("int").alias("slot_no"), *columns)


def numbered(slots: DataFrame, reps: DataFrame, conflicts: DataFrame, advisories: DataFrame, unmapped: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(question_id, decision_no from 1, kind, slot_no, subject, text, detail): decisions() before those texts that follow from kind, subject and detail.

    Most rows are of these kinds, so sentences are neither dealt out nor sorted. Rows are dealt once, by question.
    """
    for name in ("unresolved", "narrowed"):
        if name not in slots.columns:
            slots = slots.withColumn(name, F.lit(False))
    open_ = slots.filter("NOT unresolved").join(shuffled(reps.select("question_id", "slot_no").distinct()), ["question_id", "slot_no"], "left_anti")
    found = [
        _rows(slots.filter("narrowed"), "SCOPE_ASSUMPTION", "concat(coalesce(rev_lo, ''), '..', coalesce(rev_hi, ''))", "concat('The question was restricted to software revisions ', IF(rev_lo IS NULL, '', concat('from ', rev_lo, ' ')), IF(rev_hi IS NULL, 'on', concat('to ', rev_hi)), '.')"),
        _rows(slots.filter("unresolved"), "FALSE_PREMISE", "predicate"),
        _rows(conflicts, "CONFLICT", "concat(side_a, ' | ', side_b)", "concat('Sources disagree: ', side_a, ' against ', side_b, ' (', docs, ') in an overlapping scope; neither is selected.')"),
        _rows(open_, "GAP", "predicate"),
        _rows(reps.filter("assertion_kind = 'inferred'"), "INFERRED", "claim_id"),
        _rows(advisories, "ADVISORY", "claim_id", detail="why"),
    ]
    if unmapped is not None:
        found.append(_rows(unmapped.withColumn("slot_no", F.lit(None).cast("int")), "NOTE", "'unmapped'", "'The question fits no predicate that is known, so it cannot be said whether the corpus answers it.'"))
    if notes is not None:
        found.append(notes.select(*COLUMNS, F.lit(None).cast("string").alias("detail")))
    rows = reduce(DataFrame.unionByName, found).repartition("question_id")
    alike = Window.partitionBy("question_id", "kind", "subject").orderBy("slot_no", "text", "detail")
    order = Window.partitionBy("question_id").orderBy(F.expr(place("kind", KINDS)), "slot_no", "subject")
    once = rows.withColumn("of_alike", F.row_number().over(alike)).filter("of_alike = 1")
    return once.select("question_id", F.row_number().over(order).alias("decision_no"), "kind", "slot_no", "subject", "text", "detail")


def worded(decided: DataFrame) -> DataFrame:
    """numbered()'s rows with all texts."""
    words = words_for("subject", IN_WORDS, "subject")
    text = f"""coalesce(text, CASE kind WHEN 'FALSE_PREMISE' THEN concat('The question names nothing in the corpus that has a ', {words}, '.')
        WHEN 'GAP' THEN concat('No ', {words}, ' was found in the documents searched.')
        WHEN 'INFERRED' THEN concat('This is an inference (', subject, '); no document states it directly.')
        WHEN 'ADVISORY' THEN concat('Unverified: ', subject, ' (', detail, '); it is not used in this answer.') END)"""
    return decided.select("question_id", "decision_no", "kind", "slot_no", "subject", F.expr(text).alias("text"))


def decisions(slots: DataFrame, reps: DataFrame, conflicts: DataFrame, advisories: DataFrame, unmapped: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(question_id, decision_no from 1, kind, slot_no, subject, text): a row for each distinct (kind, subject) of a question.

    Ordered by kind, slot and subject, so numbers do not depend on partitioning. Slots may have narrowed and rev_lo, rev_hi
    (SCOPE_ASSUMPTION) and unresolved (FALSE_PREMISE, in place of a GAP). unmapped: question_id of questions without any
    slot. notes: further rows in COLUMNS. Each kind is an equi-join or a projection; nothing is paired.
    """
    return worded(numbered(slots, reps, conflicts, advisories, unmapped, notes))


def derived_sentences(decided: DataFrame) -> DataFrame:
    """One sentence a decision, in the shape that contract() reads."""
    return decided.select("question_id", F.lit("DERIVED").alias("kind"), "text", F.lit([]).cast("array<string>").alias("claim_ids"), F.array("decision_no").alias("decision_nos"))


def numbers(column: str) -> Column:
    return F.regexp_extract_all(column, F.lit(f"({NUMBER})"), 1)


def _sides(key: str, **sides: DataFrame) -> DataFrame:
    """(question_id, key, a boolean for each side, whole): which sides have each pair. whole: neither is null, which in a join equals nothing."""
    rows = reduce(DataFrame.unionByName, [df.select("question_id", key, F.lit(1 << i).alias("side")) for i, df in enumerate(sides.values())])
    met = rows.groupBy("question_id", key).agg(F.bit_or("side").alias("side"))
    return met.select("question_id", key, *[F.col("side").bitwiseAND(1 << i).cast("boolean").alias(name) for i, name in enumerate(sides)], F.expr(f"question_id IS NOT NULL AND {key} IS NOT NULL").alias("whole"))


def _failures(df: DataFrame, detail: str, **names: str) -> DataFrame:
    """A row for each failure (its name, where _ is a space) whose condition holds, all in one pass."""
    named = ", ".join(f"IF({condition}, '{name.replace('_', ' ')}', NULL)" for name, condition in names.items())
    return df.select("question_id", F.explode(F.expr(f"array_compact(array({named}))")).alias("failure"), F.expr(f"cast({detail} AS string)").alias("detail"))


def contract(status: DataFrame, selected: DataFrame, sentences: DataFrame, decided: DataFrame, barred: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(question_id, failure, detail): no row for an answer that keeps the contract.

    selected (question_id, claim_id, allowed array<string>, quoted boolean): the claims of an answer, the texts whose
    numbers it may state, and whether the quote stands in its source (null: not looked at). sentences (question_id, kind
    SOURCE or DERIVED, text, claim_ids, decision_nos). barred (question_id, value, unit). asked (question_id, question).
    A number is a whole token, so a barred value counts at the end of a sentence too. Claims and numbers are marked with
    the sides they are on in one grouping each; decisions meet what is shown in one join: nothing is gathered a question.
    """
    source = sentences.filter("kind = 'SOURCE'")
    cited = sentences.select("question_id", F.explode("claim_ids").alias("claim_id"))
    shown = sentences.select("question_id", F.explode("decision_nos").alias("decision_no"), F.lit(True).alias("shown"))
    stated = source.select("question_id", F.explode(numbers("text")).alias("number"))
    texts = [selected.select("question_id", F.explode("allowed").alias("t")), decided.select("question_id", F.col("subject").alias("t"))]
    if asked is not None:
        texts.append(asked.select("question_id", F.col("question").alias("t")))
    may = reduce(DataFrame.unionByName, texts).select("question_id", F.explode(numbers("t")).alias("n"))
    may = may.select("question_id", F.explode(F.expr(r"IF(n LIKE '%.%', array(n, regexp_replace(n, '^(\\d+)\\.0+$', '$1')), array(n))")).alias("number"))
    never = barred.select("question_id", F.regexp_replace(F.col("value").cast("string"), r"\.0$", "").alias("number"))
    claims, figures, by_no = _sides("claim_id", cited=cited, picked=selected), _sides("number", stated=stated, may=may, never=never), ["question_id", "decision_no"]
    apart = decided.select(*by_no, "kind", "subject", F.lit(True).alias("made")).join(shuffled(shown), by_no, "full").filter("made IS NULL OR shown IS NULL")
    gaps = decided.filter("kind = 'GAP'").select(*by_no).join(shuffled(shown), by_no, "left_semi")
    partial = status.filter("status = 'PARTIAL'").join(shuffled(gaps), "question_id", "left_anti")
    silent = status.filter("status = 'UNANSWERABLE'").join(shuffled(source), "question_id", "left_semi")
    found = [
        _failures(claims, "claim_id", claim_cited_but_not_selected="cited AND NOT (picked AND whole)", claim_selected_but_not_cited="picked AND NOT (cited AND whole)"),
        _failures(apart, "IF(made IS NULL, cast(decision_no AS string), subject)", decision_not_of_this_answer="made IS NULL", decision_not_stated="made AND kind <> 'NOTE'"),
        _failures(figures, "number", number_without_a_source="stated AND NOT (may AND whole)", value_of_another_scope="stated AND never AND whole"),
        _failures(selected, "claim_id", quote_not_in_its_source="NOT quoted"),
        _failures(silent, "status", unanswerable_but_stated="true"),
        _failures(partial, "status", partial_without_a_gap="true"),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
