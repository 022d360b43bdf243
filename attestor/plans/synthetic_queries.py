"""Queries over the synthetic claims, each with its SQL counterpart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import scope
from attestor.functions.version import contains, version_key
from attestor.functions.workers import stored, work_path
from attestor.operators import answer, decisions as decide, provenance as prove, relate, resolve
from attestor.streaming import maintained
from attestor.plans.ontology import KIND_ORDER, POLICIES, SINGLE_VALUED, TIER_ORDER, listed, place
from attestor.plans.testbed import CLAIMS_SQL, claims, duck_describe, duck_key, duck_relation, duck_rev_relation, duck_wider

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def slots_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slots for each part: its pressure, its start-up state, and where it is; the scope follows the part's size."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    preds = "array(named_struct('n', 1, 'p', 'applicability_scope', 'r', true), named_struct('n', 2, 'p', 'requires_state', 'r', true), named_struct('n', 3, 'p', 'located_at', 'r', false))"
    s = p.selectExpr("p_partkey", "p_size", f"explode({preds}) AS x").selectExpr(
        "p_partkey AS question_id", "x.n AS slot_no", "x.p AS predicate", "array(concat('component:', p_partkey)) AS entities", "false AS system", "cast(NULL AS array<string>) AS pair", "cast(NULL AS string) AS op",
        "cast(NULL AS double) AS qty", "cast(NULL AS string) AS unit", "IF(p_size % 3 = 0, 'KEY_MAPPING', 'PARAMETER') AS policy", "x.r AS required",
        "IF(p_size % 4 = 0, 'any', 'ver') AS rev_kind", "CASE p_size % 4 WHEN 1 THEN '1.12' WHEN 3 THEN '1.13' END AS rev_lo", "CASE p_size % 4 WHEN 2 THEN '1.12' WHEN 3 THEN '1.13' END AS rev_hi", "true AS rev_lo_inc", "p_size % 4 = 3 AS rev_hi_inc",
    )
    return s.withColumn("lo_k", F.expr(version_key("rev_lo"))).withColumn("hi_k", F.expr(version_key("rev_hi")))


SLOTS_SQL = f"""{CLAIMS_SQL}, s0 AS (
  SELECT p_partkey AS question_id, n AS slot_no, p AS predicate, CASE WHEN p = 'applicability_scope' THEN 'normal_operating_pressure' ELSE p END AS s_predicate, r AS required, 'component:' || p_partkey AS s_entity,
         CASE WHEN p_size % 3 = 0 THEN 'KEY_MAPPING' ELSE 'PARAMETER' END AS policy, CASE WHEN p_size % 4 = 0 THEN 'any' ELSE 'ver' END AS rev_kind,
         CASE p_size % 4 WHEN 1 THEN '1.12' WHEN 3 THEN '1.13' END AS rev_lo, CASE p_size % 4 WHEN 2 THEN '1.12' WHEN 3 THEN '1.13' END AS rev_hi, true AS rev_lo_inc, p_size % 4 = 3 AS rev_hi_inc
  FROM part, (VALUES (1, 'applicability_scope', true), (2, 'requires_state', true), (3, 'located_at', false)) AS x(n, p, r)),
slots AS (SELECT *, {duck_key('rev_lo')} AS lo_k, {duck_key('rev_hi')} AS hi_k FROM s0),
cand AS (SELECT c.*, q.question_id, q.slot_no, q.predicate AS slot_predicate, q.policy, q.required, {duck_rev_relation('c.', 'q.')} AS rr FROM visible c JOIN slots q ON c.predicate = q.s_predicate AND c.entity_id = q.s_entity),
disp AS (SELECT *, CASE WHEN needs_review THEN 'excluded: needs review' WHEN rr = 'DISJOINT' THEN 'excluded: scope disjoint' WHEN rr = 'UNKNOWN' OR sensor_kind = 'unknown' THEN 'excluded: scope unknown'
    WHEN tier = 'field_observation' THEN 'excluded: field observation' WHEN policy = 'PARAMETER' AND assertion_kind = 'inferred' THEN 'supporting'
    WHEN tier IN ('primary', 'reference') THEN 'applicable' ELSE 'supporting' END AS disposition FROM cand)"""
REPS_SQL = f"""{SLOTS_SQL},
app AS (SELECT *, coalesce(item, '') AS it, {duck_describe()} AS scope_text, {place('assertion_kind', KIND_ORDER)} AS k1, CASE WHEN sensor_kind = 'ent' THEN 0 ELSE 1 END AS k2, {place('tier', TIER_ORDER)} AS k3 FROM disp WHERE disposition = 'applicable'),
nv AS (SELECT question_id, slot_no, entity_id, predicate, it, count(DISTINCT vkey) AS n_values FROM app GROUP BY ALL),
wide AS (SELECT a.*, n_values > 1 AND a.predicate IN ({listed(SINGLE_VALUED)}) AS split FROM app a JOIN nv USING (question_id, slot_no, entity_id, predicate, it)),
top AS (SELECT * FROM wide a WHERE NOT EXISTS (SELECT 1 FROM wide b WHERE b.question_id = a.question_id AND b.slot_no = a.slot_no AND b.entity_id = a.entity_id AND b.predicate = a.predicate AND b.it = a.it AND b.vkey = a.vkey AND {duck_wider('b.', 'a.')})),
mem AS (SELECT question_id, slot_no, entity_id, predicate, it, vkey, count(*) AS n_members FROM wide GROUP BY ALL),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, slot_no, entity_id, predicate, it, vkey, CASE WHEN split THEN scope_text ELSE '' END ORDER BY k1, k2, k3, claim_id) AS r FROM top) WHERE r = 1),
rels AS (SELECT a.claim_id AS src, b.claim_id AS dst, a.vkey AS v1, b.vkey AS v2, {duck_relation()} AS relation, a.predicate, a.doc_id AS d1, b.doc_id AS d2
         FROM visible a JOIN visible b ON a.entity_id = b.entity_id AND a.predicate = b.predicate AND coalesce(a.item, '') = coalesce(b.item, '') AND a.claim_id < b.claim_id WHERE NOT a.needs_review AND NOT b.needs_review)"""
CONF_SQL = f"""{REPS_SQL},
conf AS (SELECT x.question_id, x.slot_no, least(v1, v2) AS side_a, greatest(v1, v2) AS side_b, count(*) AS n_pairs FROM rels JOIN app x ON x.claim_id = src JOIN app y ON y.claim_id = dst AND y.question_id = x.question_id AND y.slot_no = x.slot_no
         WHERE v1 <> v2 AND relation = 'OVERLAP' AND rels.predicate IN ({listed(SINGLE_VALUED)}) GROUP BY ALL)"""


@query(f"{CLAIMS_SQL} SELECT claim_id, entity_id, predicate, lifecycle FROM visible")
def visible_claims(spark, sf_dir):
    return relate.visible(claims(spark, sf_dir)).select("claim_id", "entity_id", "predicate", "lifecycle")


@query(f"{CLAIMS_SQL} SELECT lifecycle, CAST(count(*) AS BIGINT) AS n FROM claims GROUP BY lifecycle")
def lifecycle_counts(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("lifecycle").agg(F.count(F.lit(1)).alias("n"))


@query(f"{CLAIMS_SQL} SELECT coalesce(predicate, 'all') AS predicate, coalesce(lifecycle, 'all') AS lifecycle, CAST(count(*) AS BIGINT) AS n FROM claims GROUP BY ROLLUP (predicate, lifecycle)")
def lifecycle_rollup(spark, sf_dir):
    r = claims(spark, sf_dir).rollup("predicate", "lifecycle").agg(F.count(F.lit(1)).alias("n"))
    return r.select(F.coalesce("predicate", F.lit("all")).alias("predicate"), F.coalesce("lifecycle", F.lit("all")).alias("lifecycle"), "n")


@query(f"""{CLAIMS_SQL}, v AS (SELECT DISTINCT unnest([coalesce(rev_lo, rev_hi), coalesce(rev_lo, rev_hi) || '.0', coalesce(rev_lo, rev_hi) || '.1', '1.9']) AS v FROM claims WHERE rev_kind = 'ver')
    SELECT v, CAST(dense_rank() OVER (ORDER BY {duck_key('v')}) AS BIGINT) AS place FROM v""")
def version_order(spark, sf_dir):
    from pyspark.sql.window import Window

    v = claims(spark, sf_dir).filter("rev_kind = 'ver'").selectExpr("coalesce(rev_lo, rev_hi) AS v").distinct()
    v = v.selectExpr("explode(array(v, concat(v, '.0'), concat(v, '.1'), '1.9')) AS v").distinct().withColumn("k", F.expr(version_key("v")))
    return v.select("v", F.dense_rank().over(Window.orderBy("k")).cast("long").alias("place"))  # a handful of distinct versions


def _duck_contains(k: str) -> str:
    return f"((lo_k IS NULL OR {k} > lo_k OR ({k} = lo_k AND rev_lo_inc)) AND (hi_k IS NULL OR {k} < hi_k OR ({k} = hi_k AND rev_hi_inc)))"


@query(f"""{CLAIMS_SQL}, q AS (SELECT v, {duck_key('v')} AS k FROM (VALUES ('1.11'), ('1.12.0'), ('1.14'), ('1.9')) AS t(v))
    SELECT v, predicate, CAST(count(*) AS BIGINT) AS n FROM claims JOIN q ON rev_kind = 'ver' AND {_duck_contains('k')} GROUP BY v, predicate""")
def version_contains(spark, sf_dir):
    c = claims(spark, sf_dir).filter("rev_kind = 'ver'").withColumn("v", F.explode(F.array(*map(F.lit, ["1.11", "1.12.0", "1.14", "1.9"]))))
    return c.withColumn("k", F.expr(version_key("v"))).filter(F.expr(contains("k", "lo_k", "hi_k", "rev_lo_inc", "rev_hi_inc"))).groupBy("v", "predicate").agg(F.count(F.lit(1)).alias("n"))


PAIRS_SQL = f"""{CLAIMS_SQL}, pairs AS (SELECT a.predicate, a.vkey = b.vkey AS same, {duck_relation()} AS relation, a.claim_id AS src, b.claim_id AS dst, a.doc_id AS d1, b.doc_id AS d2, a.derived_from AS from1, b.derived_from AS from2, a.needs_review OR b.needs_review AS review
    FROM visible a JOIN visible b ON a.entity_id = b.entity_id AND a.predicate = b.predicate AND coalesce(a.item, '') = coalesce(b.item, '') AND a.claim_id < b.claim_id)"""
_IND = "(d1 <> d2 AND NOT list_contains(from1, d2) AND NOT list_contains(from2, d1))"


@query(f"{PAIRS_SQL} SELECT predicate, same, relation, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY ALL")
def scope_relation(spark, sf_dir):
    p = relate.slot_pairs(relate.visible(claims(spark, sf_dir)))
    return p.groupBy("predicate", F.expr("a_vkey = b_vkey").alias("same"), "relation").agg(F.count(F.lit(1)).alias("n"))


RELS_SQL = f"""{PAIRS_SQL}, rel AS (
    SELECT 'corroborates' AS kind, src, dst, {_IND} AS independent FROM pairs WHERE NOT review AND same AND relation = 'OVERLAP'
    UNION ALL SELECT 'derived_from', src, dst, false FROM pairs WHERE NOT review AND same AND relation = 'OVERLAP' AND NOT {_IND} AND d1 <> d2
    UNION ALL SELECT CASE relation WHEN 'OVERLAP' THEN 'conflicts_with' ELSE 'version_scoped_with' END, src, dst, true FROM pairs WHERE NOT review AND NOT same AND relation <> 'UNKNOWN' AND predicate IN ({listed(SINGLE_VALUED)}))"""


@query(f"{RELS_SQL} SELECT kind, src, dst, independent FROM rel")
def relations(spark, sf_dir):
    return relate.relations(claims(spark, sf_dir))


@query(SQL["relations"])
def maintained_relations(spark, sf_dir):
    """relations' rows from a store that took the claims in five batches of documents. The first batch comes unreviewed, is sent
    again by the last one as it should be, and the third arrives twice."""
    c, path = stored(claims(spark, sf_dir), "claims"), work_path(spark, "store")
    group = F.col("doc_no") % 4
    batches = [(f"docs-{k}", c.filter(group == k)) for k in range(4)]
    batches[0] = ("draft", batches[0][1].withColumn("needs_review", F.lit(False)).withColumn("rev_kind", F.lit("any")))
    for name, batch in [*batches[:3], batches[2], batches[3], ("docs-0", c.filter(group == 0))]:
        maintained.put(spark, path, batch, name)
    return maintained.relations(spark, path)


@query(f"{RELS_SQL} SELECT kind, independent, CAST(count(*) AS BIGINT) AS n FROM rel GROUP BY ALL")
def relation_counts(spark, sf_dir):
    return relate.relation_counts(claims(spark, sf_dir))


@query(f"""{CLAIMS_SQL}, q AS (SELECT 'ver' AS rev_kind, '1.11' AS rev_lo, '1.14' AS rev_hi, true AS rev_lo_inc, false AS rev_hi_inc, {duck_key("'1.11'")} AS lo_k, {duck_key("'1.14'")} AS hi_k),
    m AS (SELECT a.claim_id, a.rev_kind AS ak, a.rev_lo AS alo, a.rev_hi AS ahi, a.rev_hi_inc AS ahinc, a.lo_k AS alk, a.hi_k AS ahk, q.lo_k AS blk, q.hi_k AS bhk, {duck_rev_relation('a.', 'q.')} AS r FROM claims a, q)
    SELECT claim_id, CASE WHEN ak = 'unknown' THEN 'unknown' WHEN ak = 'any' THEN '[1.11, 1.14)' WHEN r = 'DISJOINT' THEN 'empty' ELSE
        CASE WHEN (CASE WHEN alk IS NULL OR blk > alk THEN '1.11' ELSE alo END) = (CASE WHEN ahk IS NULL OR bhk < ahk OR (bhk = ahk) THEN '1.14' ELSE ahi END) THEN '=' || alo
        ELSE '[' || (CASE WHEN alk IS NULL OR blk > alk THEN '1.11' ELSE alo END) || ', ' || (CASE WHEN ahk IS NULL OR bhk < ahk OR bhk = ahk THEN '1.14' ELSE ahi END)
             || (CASE WHEN ahk IS NULL OR bhk < ahk OR bhk = ahk THEN ')' WHEN ahinc THEN ']' ELSE ')' END) END END AS met FROM m""")
def scope_meet(spark, sf_dir):
    c = claims(spark, sf_dir)
    a = c.select("claim_id", *[F.col(x).alias(f"a_{x}") for x in resolve.REV])
    a = a.selectExpr("*", "'ver' AS b_rev_kind", "'1.11' AS b_rev_lo", "'1.14' AS b_rev_hi", "true AS b_rev_lo_inc", "false AS b_rev_hi_inc", f"{version_key(repr('1.11'))} AS b_lo_k", f"{version_key(repr('1.14'))} AS b_hi_k")
    m = a.withColumn("m", F.expr(scope.meet("a_", "b_")))
    m = m.selectExpr("claim_id", "m.kind AS rev_kind", "m.lo AS rev_lo", "m.hi AS rev_hi", "m.lo_inc AS rev_lo_inc", "m.hi_inc AS rev_hi_inc")
    return m.select("claim_id", F.expr(f"IF(rev_kind IS NULL, 'empty', {scope.describe()})").alias("met"))


@query(f"""{CLAIMS_SQL} SELECT claim_id FROM claims a WHERE NOT EXISTS (SELECT 1 FROM claims b WHERE b.entity_id = a.entity_id AND b.predicate = a.predicate AND coalesce(b.item, '') = coalesce(a.item, '') AND b.vkey = a.vkey AND {duck_wider('b.', 'a.')})""")
def maximal_scope(spark, sf_dir):
    return relate.maximal(claims(spark, sf_dir), ["entity_id", "predicate", "item", "vkey"]).select("claim_id")


@query(f"""{CLAIMS_SQL}, top AS (SELECT * FROM visible a WHERE NOT EXISTS (SELECT 1 FROM visible b WHERE b.entity_id = a.entity_id AND b.predicate = a.predicate AND coalesce(b.item, '') = coalesce(a.item, '') AND b.vkey = a.vkey AND {duck_wider('b.', 'a.')}))
    SELECT entity_id, predicate, item, vkey, claim_id, n_widest FROM (SELECT *, CAST(count(*) OVER w AS BIGINT) AS n_widest, row_number() OVER (w ORDER BY {place('assertion_kind', KIND_ORDER)}, CASE WHEN sensor_kind = 'ent' THEN 0 ELSE 1 END, {place('tier', TIER_ORDER)}, claim_id) AS r
    FROM top WINDOW w AS (PARTITION BY entity_id, predicate, item, vkey)) WHERE r = 1""")
def representatives(spark, sf_dir):
    return relate.representatives(relate.visible(claims(spark, sf_dir))).select("entity_id", "predicate", "item", "vkey", "claim_id", "n_widest")


@query(f"{SLOTS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, claim_id FROM cand")
def slot_candidates(spark, sf_dir):
    return resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",)).select("question_id", "slot_no", "claim_id")


@query(f"{SLOTS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, claim_id, disposition FROM disp")
def exclusion_cascade(spark, sf_dir):
    return resolve.dispose(resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",))).select("question_id", "slot_no", "claim_id", "disposition")


@query(f"""{SLOTS_SQL} SELECT CASE WHEN needs_review THEN 'excluded: needs review' WHEN policy = 'PARAMETER' AND assertion_kind = 'inferred' AND tier <> 'field_observation' THEN 'supporting' WHEN tier = 'field_observation' THEN 'excluded: field observation'
    WHEN tier IN ('primary', 'reference') THEN 'applicable' ELSE 'supporting' END AS disposition, CAST(count(*) AS BIGINT) AS n FROM cand GROUP BY ALL""")
def ablation_without_scope(spark, sf_dir):
    d = resolve.dispose(resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",)), frozenset({"scope"}))
    return d.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query(f"{REPS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, claim_id, vkey, scope_text, CAST(n_members AS BIGINT) AS n_members FROM rep JOIN mem USING (question_id, slot_no, entity_id, predicate, it, vkey)")
def slot_resolution(spark, sf_dir):
    d = resolve.dispose(resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",)))
    return resolve.representatives(d).select("question_id", "slot_no", "claim_id", "vkey", "scope_text", "n_members")


@query(f"""{REPS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, entity_id, CAST(count(DISTINCT vkey) AS BIGINT) AS n_values, string_agg(vkey || ' ' || scope_text, '; ' ORDER BY vkey || ' ' || scope_text) AS branches FROM rep
    WHERE predicate IN ({listed(SINGLE_VALUED)}) GROUP BY question_id, slot_no, entity_id, predicate, it HAVING count(DISTINCT vkey) > 1""")
def scope_branches(spark, sf_dir):
    d = resolve.dispose(resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",)))
    r = resolve.representatives(d).filter(F.col("predicate").isin(*SINGLE_VALUED))
    g = r.groupBy("question_id", "slot_no", "entity_id", "predicate", "item").agg(F.countDistinct("vkey").alias("n_values"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "vkey", "scope_text"))), "; ").alias("branches"))
    return g.filter("n_values > 1").select("question_id", "slot_no", "entity_id", "n_values", "branches")


@query(f"{CONF_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, side_a, side_b, CAST(n_pairs AS BIGINT) AS n_pairs FROM conf")
def conflict_sides(spark, sf_dir):
    c = claims(spark, sf_dir)
    d = resolve.dispose(resolve.candidates(c, slots_of_parts(spark, sf_dir), kinds=("entity",)))
    return resolve.conflicts(d, relate.relations(c)).select("question_id", "slot_no", "side_a", "side_b", "n_pairs")


def _disposed(spark: SparkSession, sf_dir: str, slots: DataFrame, *kept: str) -> DataFrame:
    """The candidates of those dispositions, neither being that of a claim in review, written once with what later steps read."""
    d = resolve.dispose(resolve.candidates(claims(spark, sf_dir).filter("NOT coalesce(needs_review, false)"), slots, kinds=("entity",)))
    columns = ["question_id", "slot_no", "claim_id", "entity_id", "predicate", "item", "vkey", "value", "unit", "value_type", "v_text", "assertion_kind", "tier", "doc_id", "needs_review", "sensor_kind", "sensor_ids", *resolve.REV, "disposition"]
    return stored(d.filter(F.col("disposition").isin(*kept)).select(*columns), "disposed")


@query(f"""{CONF_SQL}, st AS (SELECT s.question_id, s.slot_no, EXISTS (SELECT 1 FROM rep r WHERE r.question_id = s.question_id AND r.slot_no = s.slot_no) AS covered, EXISTS (SELECT 1 FROM conf c WHERE c.question_id = s.question_id AND c.slot_no = s.slot_no) AS conflicted,
    EXISTS (SELECT 1 FROM rep r WHERE r.question_id = s.question_id AND r.slot_no = s.slot_no AND r.predicate IN ({listed(SINGLE_VALUED)}) GROUP BY r.entity_id, r.predicate, r.it HAVING count(DISTINCT r.vkey) > 1) AS branched FROM slots s WHERE s.required)
    SELECT question_id, CASE WHEN bool_or(conflicted) THEN 'CONFLICTED' WHEN bool_and(covered) AND bool_or(branched) THEN 'ANSWERED_SCOPED' WHEN bool_and(covered) THEN 'ANSWERED' WHEN bool_or(covered) THEN 'PARTIAL' ELSE 'UNANSWERABLE' END AS status FROM st GROUP BY question_id""")
def answer_gate(spark, sf_dir):
    slots = slots_of_parts(spark, sf_dir)
    disposed = _disposed(spark, sf_dir, slots, "applicable")
    reps = stored(resolve.representatives(disposed), "reps")
    return resolve.gate(slots, reps, resolve.conflicts_within(disposed))


@query(f"""{SLOTS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, claim_id, CASE WHEN needs_review THEN 'needs review' WHEN tier = 'field_observation' THEN 'field observation' ELSE 'scope not established' END AS why
    FROM slots s JOIN (SELECT *, predicate AS asp FROM visible WHERE needs_review OR rev_kind = 'unknown' UNION ALL SELECT *, 'normal_operating_pressure' FROM visible WHERE predicate = 'observed_pressure') v ON v.asp = s.s_predicate AND v.entity_id = s.s_entity""")
def advisories(spark, sf_dir):
    return resolve.advisories(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), named_only=True).select("question_id", "slot_no", "claim_id", "why")


DECISIONS_SQL = f"""{CONF_SQL},
adv AS (SELECT question_id, slot_no, claim_id FROM slots s JOIN (SELECT *, predicate AS asp FROM visible WHERE needs_review OR rev_kind = 'unknown' UNION ALL SELECT *, 'normal_operating_pressure' FROM visible WHERE predicate = 'observed_pressure') v ON v.asp = s.s_predicate AND v.entity_id = s.s_entity),
dec0 AS (SELECT question_id, slot_no, 'CONFLICT' AS kind, 3 AS k, side_a || ' | ' || side_b AS subject FROM conf
    UNION ALL SELECT question_id, slot_no, 'GAP', 4, predicate FROM slots s WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.question_id = s.question_id AND r.slot_no = s.slot_no)
    UNION ALL SELECT question_id, slot_no, 'INFERRED', 6, claim_id FROM rep WHERE assertion_kind = 'inferred' UNION ALL SELECT question_id, slot_no, 'ADVISORY', 8, claim_id FROM adv),
dec1 AS (SELECT question_id, kind, k, subject, min(slot_no) AS slot_no FROM dec0 GROUP BY ALL),
dec AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY k, slot_no, subject) AS decision_no, kind, slot_no, subject FROM dec1)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The parts' slots resolved, and their decisions but for the texts that follow from them, each table written once: they are read several times."""
    slots = slots_of_parts(spark, sf_dir)
    disposed = _disposed(spark, sf_dir, slots, "applicable", "excluded: scope disjoint")
    reps = stored(resolve.representatives(disposed), "reps")
    conflict = stored(resolve.conflicts_within(disposed), "conflicts")
    out = {"disposed": disposed, "reps": reps, "conflicts": conflict, "status": resolve.gate(slots, reps, conflict)}
    return out, decide.numbered(slots, reps, conflict, resolve.advisories(claims(spark, sf_dir), slots, named_only=True))


@query(f"{DECISIONS_SQL} SELECT question_id, CAST(decision_no AS INT) AS decision_no, kind, CAST(slot_no AS INT) AS slot_no, subject FROM dec")
def decisions(spark, sf_dir):
    return decide.worded(_resolved(spark, sf_dir)[1]).drop("text")


@query(f"""{DECISIONS_SQL}, st AS (SELECT s.question_id, s.slot_no, EXISTS (SELECT 1 FROM rep r WHERE r.question_id = s.question_id AND r.slot_no = s.slot_no) AS covered, EXISTS (SELECT 1 FROM conf c WHERE c.question_id = s.question_id AND c.slot_no = s.slot_no) AS conflicted FROM slots s WHERE s.required),
    status AS (SELECT question_id, NOT bool_or(conflicted) AND NOT bool_or(covered) AS nothing, NOT bool_or(conflicted) AND bool_or(covered) AND NOT bool_and(covered) AS part FROM st GROUP BY question_id),
    said AS (SELECT question_id, 'Part ' || entity_id || ': ' || vkey || ' (' || scope_text || ')' || CASE question_id % 10 WHEN 3 THEN ' 999' WHEN 5 THEN ' 150' ELSE '' END AS text, CASE question_id % 10 WHEN 1 THEN [] WHEN 2 THEN [claim_id, 'C0'] ELSE [claim_id] END AS ids FROM rep),
    cited AS (SELECT DISTINCT question_id, unnest(ids) AS claim_id FROM said), told AS (SELECT * FROM dec WHERE question_id % 10 <> 4),
    stated AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(text, '\\d+(?:\\.\\d+)*')) AS number FROM said),
    may0 AS (SELECT question_id, unnest([vkey, entity_id, scope_text]) AS t FROM rep UNION ALL SELECT question_id, subject FROM dec), may1 AS (SELECT question_id, unnest(regexp_extract_all(t, '\\d+(?:\\.\\d+)*')) AS n FROM may0),
    may AS (SELECT question_id, n AS number FROM may1 UNION SELECT question_id, regexp_replace(n, '^(\\d+)\\.0+$', '\\1') FROM may1),
    never AS (SELECT DISTINCT question_id, regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') AS number FROM disp d WHERE disposition = 'excluded: scope disjoint' AND value_type = 'quantity' AND NOT EXISTS (SELECT 1 FROM rep r WHERE r.question_id = d.question_id AND r.vkey = d.vkey))
    SELECT question_id, 'claim cited but not selected' AS failure, claim_id AS detail FROM cited c WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.question_id = c.question_id AND r.claim_id = c.claim_id)
    UNION SELECT question_id, 'claim selected but not cited', claim_id FROM rep r WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE r.question_id = c.question_id AND r.claim_id = c.claim_id)
    UNION SELECT question_id, 'decision not stated', subject FROM dec WHERE question_id % 10 = 4
    UNION SELECT question_id, 'number without a source', number FROM stated ANTI JOIN may USING (question_id, number)
    UNION SELECT question_id, 'value of another scope', number FROM stated SEMI JOIN never USING (question_id, number)
    UNION SELECT question_id, 'quote not in its source', claim_id FROM rep WHERE question_id % 10 = 6
    UNION SELECT question_id, 'unanswerable but stated', 'UNANSWERABLE' FROM status WHERE nothing AND question_id IN (SELECT question_id FROM said)
    UNION SELECT question_id, 'partial without a gap', 'PARTIAL' FROM status WHERE part AND question_id NOT IN (SELECT question_id FROM told WHERE kind = 'GAP')""")
def contract_checks(spark, sf_dir):
    """Answers with planted faults, by the last digit of the question: citations left out or foreign, strange and barred numbers, decisions unsaid, quotes astray."""
    out, decided = _resolved(spark, sf_dir)
    decided, reps, digit = decide.worded(stored(decided, "decisions")), out["reps"], F.expr("question_id % 10")
    text = F.concat(F.lit("Part "), "entity_id", F.lit(": "), "vkey", F.lit(" ("), "scope_text", F.lit(")"), F.when(digit == 3, " 999").when(digit == 5, " 150").otherwise(""))
    ids = F.expr("CASE question_id % 10 WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array(claim_id, 'C0') ELSE array(claim_id) END")
    said = reps.select("question_id", F.lit("SOURCE").alias("kind"), text.alias("text"), ids.alias("claim_ids"), F.lit([]).cast("array<int>").alias("decision_nos"))
    said = said.unionByName(decide.derived_sentences(decided).filter(digit != 4))
    selected = reps.select("question_id", "claim_id", F.array("vkey", "entity_id", "scope_text").alias("allowed"), (digit != 6).alias("quoted"))
    return decide.contract(out["status"], selected, said, decided, answer.forbidden(out["disposed"], reps))


def _other_end(c: DataFrame) -> DataFrame:
    """Entity-valued claims: each requires_state claim points at the component with the next number."""
    return c.withColumn("value_id", F.expr("IF(predicate = 'requires_state', concat('component:', cast(substring(entity_id, 11) AS BIGINT) + 1), NULL)"))


@query(f"""{CLAIMS_SQL}, e AS (SELECT *, 'component:' || (CAST(substr(entity_id, 11) AS BIGINT) + 1) AS value_id FROM visible WHERE predicate = 'requires_state')
    SELECT p_partkey AS question_id, claim_id FROM part JOIN e ON least(entity_id, value_id) = least('component:' || p_partkey, 'component:' || (p_partkey + 1)) AND greatest(entity_id, value_id) = greatest('component:' || p_partkey, 'component:' || (p_partkey + 1))""")
def pair_lookup(spark, sf_dir):
    s = slots_of_parts(spark, sf_dir).filter("slot_no = 2").withColumn("pair", F.expr("array(concat('component:', question_id + 1), concat('component:', question_id))"))
    return resolve.candidates(_other_end(claims(spark, sf_dir)), s, kinds=("pair",)).select("question_id", "claim_id")


@query(f"""{CLAIMS_SQL}, q AS (SELECT * FROM (VALUES (1, '<', 160.0), (2, '>', 170.0), (3, '<', 150.0)) AS t(question_id, op, qty)),
    k AS (SELECT *, CASE WHEN doc_no % 2 = 0 THEN '<' ELSE '>' END AS cond_op FROM visible WHERE predicate = 'observed_pressure')
    SELECT CAST(question_id AS BIGINT) AS question_id, claim_id, entity_id FROM q JOIN k ON cond_op = op AND abs(value - qty) <= 1e-6 * greatest(1.0, abs(value))""")
def reverse_lookup(spark, sf_dir):
    c = claims(spark, sf_dir).withColumn("seen", F.expr("predicate = 'observed_pressure'")).withColumn("cond_op", F.expr("IF(seen, IF(doc_no % 2 = 0, '<', '>'), NULL)")).withColumn("cond_value", F.expr("IF(seen, value, NULL)")).withColumn("cond_unit", F.expr("IF(seen, unit, NULL)"))
    rows = [(i, 1, "observed_pressure", [], False, None, op, q, "bar", "PARAMETER", True, "any", None, None, True, False, None, None) for i, op, q in ((1, "<", 160.0), (2, ">", 170.0), (3, "<", 150.0))]
    s = spark.createDataFrame(rows, "question_id long, slot_no int, predicate string, entities array<string>, system boolean, pair array<string>, op string, qty double, unit string, policy string, required boolean, rev_kind string, rev_lo string, rev_hi string, rev_lo_inc boolean, rev_hi_inc boolean, lo_k array<int>, hi_k array<int>")
    return resolve.candidates(c, s, count=len(rows), kinds=("value",)).select("question_id", "claim_id", "entity_id")


@query(f"""{PAIRS_SQL}, ways AS (SELECT src AS claim_id, dst AS other, d1 AS da, d2 AS db, {_IND} AS ind FROM pairs WHERE same AND relation = 'OVERLAP' AND d1 <> d2 UNION ALL SELECT dst, src, d2, d1, {_IND} FROM pairs WHERE same AND relation = 'OVERLAP' AND d1 <> d2),
    f AS (SELECT claim_id, db, arg_min(ind, other) AS ind FROM ways GROUP BY claim_id, db)
    SELECT claim_id, CAST(count(*) FILTER (ind) AS BIGINT) AS n_independent, CAST(count(*) FILTER (NOT ind) AS BIGINT) AS n_derived FROM f GROUP BY claim_id""")
def corroboration(spark, sf_dir):
    return relate.corroboration(relate.visible(claims(spark, sf_dir)))


@query(f"""{CLAIMS_SQL}, k AS (SELECT * FROM visible WHERE predicate = 'config_key_value'), t AS (SELECT * FROM visible WHERE predicate IN ('normal_operating_pressure', 'alarm_trigger_condition', 'reset_pressure_limit') AND assertion_kind = 'stated' AND NOT needs_review),
    ds AS (SELECT DISTINCT value, unit, rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, lo_k, hi_k, sensor_kind, sensor_ids FROM k), dt AS (SELECT DISTINCT value, unit, rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, lo_k, hi_k, sensor_kind, sensor_ids, predicate || ' of ' || entity_id AS target FROM t),
    m AS (SELECT a.value, a.rev_kind, a.rev_lo, a.rev_hi, a.sensor_kind, a.sensor_ids, count(DISTINCT target) AS n, min(target) AS target FROM ds a JOIN dt b ON a.value = b.value AND a.unit = b.unit AND {duck_relation()} = 'OVERLAP' GROUP BY ALL)
    SELECT claim_id, CASE WHEN n = 1 THEN target END AS target, n > 1 AS ambiguous FROM k JOIN m ON k.value = m.value AND k.rev_kind = m.rev_kind AND k.rev_lo IS NOT DISTINCT FROM m.rev_lo AND k.rev_hi IS NOT DISTINCT FROM m.rev_hi AND k.sensor_kind = m.sensor_kind AND k.sensor_ids = m.sensor_ids""")
def infer_mapping(spark, sf_dir):
    return relate.infer_mapping(claims(spark, sf_dir))


@query(f"""{REPS_SQL} SELECT question_id, CAST(slot_no AS INT) AS slot_no, claim_id, 'primary' AS role, doc_id FROM rep
    UNION SELECT r.question_id, CAST(r.slot_no AS INT), r.claim_id, CASE WHEN list_contains(r.derived_from, a.doc_id) OR list_contains(a.derived_from, r.doc_id) THEN 'derived' ELSE 'corroborating' END, a.doc_id
    FROM rep r JOIN app a USING (question_id, slot_no, entity_id, predicate, it, vkey) WHERE a.doc_id <> r.doc_id""")
def answer_evidence(spark, sf_dir):
    d = resolve.dispose(resolve.candidates(claims(spark, sf_dir), slots_of_parts(spark, sf_dir), kinds=("entity",)))
    return prove.evidence(resolve.representatives(d), d)


@query(f"""SELECT 'I:R-CFGKEY-01:' || m.claim_id AS inferred_id, 'R-CFGKEY-01' AS rule, 'component:' || CAST(CAST(substr(m.claim_id, 14, 9) AS BIGINT) AS VARCHAR) AS entity_id, 'config_key_maps_to' AS predicate, target AS value, m.claim_id AS from_claim FROM ({SQL['infer_mapping']}) m WHERE NOT ambiguous
    UNION ALL SELECT 'I:R-SUPERSEDED-DISTINCT:' || claim_id, 'R-SUPERSEDED-DISTINCT', 'component:' || (CAST(substr(entity_id, 11) AS BIGINT) + 1), 'is_distinct_from', entity_id, claim_id
    FROM ({CLAIMS_SQL} SELECT * FROM visible WHERE predicate = 'requires_state' AND assertion_kind = 'stated' AND NOT needs_review)""")
def inferred_claims(spark, sf_dir):
    """The start-up states of the test bed stand for supersessions, each part by the next."""
    return prove.inferred_claims(_other_end(claims(spark, sf_dir)).withColumn("predicate", F.expr("IF(predicate = 'requires_state', 'superseded_by', predicate)")))


@query(f"""{CLAIMS_SQL}, s AS (SELECT *, 'component:' || (CAST(substr(entity_id, 11) AS BIGINT) + 1) AS value_id, {duck_describe()} AS scope_text FROM visible WHERE predicate = 'requires_state' AND NOT needs_review),
    l AS (SELECT DISTINCT CAST(substr(entity_id, 11) AS BIGINT) AS n FROM s), o AS (SELECT *, {duck_describe()} AS scope_text FROM visible WHERE predicate = 'located_at' AND NOT needs_review AND tier IN ('primary', 'reference'))
    SELECT n AS question_id, min(claim_id) AS claim_id, 'identity' AS why FROM l JOIN s ON CAST(substr(entity_id, 11) AS BIGINT) = n JOIN part ON p_partkey = n WHERE tier IN ('primary', 'reference') GROUP BY n, entity_id, vkey, scope_text
    UNION ALL SELECT n, min(claim_id), 'identity' FROM l JOIN o ON CAST(substr(entity_id, 11) AS BIGINT) IN (n, n + 1) JOIN part ON p_partkey = n GROUP BY n, entity_id, vkey, scope_text""")
def expansions(spark, sf_dir):
    """Start-up states stand for supersessions and places for support: what an answer on each part and the next takes in besides."""
    c = _other_end(claims(spark, sf_dir)).withColumn("predicate", F.expr("CASE predicate WHEN 'requires_state' THEN 'superseded_by' WHEN 'located_at' THEN 'supported_on' ELSE predicate END"))
    s = slots_of_parts(spark, sf_dir).filter("slot_no = 2").withColumn("policy", F.lit("IDENTITY")).withColumn("pair", F.expr("array(concat('component:', question_id + 1), concat('component:', question_id))"))
    nothing = c.limit(0).select(F.lit(0).cast("long").alias("question_id"), "claim_id")
    return prove.expansions(nothing, s, c)


@query(f"""{CLAIMS_SQL}, one AS (SELECT * FROM claims WHERE lifecycle = 'ADMITTED' AND assertion_kind <> 'inferred'), two AS (SELECT * FROM claims WHERE lifecycle = 'ADMITTED' AND assertion_kind = 'inferred'),
    j AS (SELECT a.claim_id, coalesce(b.claim_id IS NOT NULL AND {duck_relation()} = 'OVERLAP', false) AS ov, b.claim_id AS other, a.vkey = b.vkey AS eq, a.predicate IN ({listed(SINGLE_VALUED)}) AND coalesce(a.item, '') = coalesce(b.item, '') AS single FROM two a LEFT JOIN one b ON a.entity_id = b.entity_id AND a.predicate = b.predicate),
    g AS (SELECT claim_id, bool_or(coalesce(ov AND NOT eq AND single, false)) AS d, bool_or(coalesce(ov AND eq, false)) AS e FROM j GROUP BY claim_id)
    SELECT claim_id, 'second' AS reader, CASE WHEN d THEN 'disagree' WHEN e THEN 'agree' ELSE 'unconfirmed' END AS outcome, CASE WHEN d THEN 'DEMOTED' WHEN e THEN 'REJECTED' ELSE 'DEMOTED' END AS lifecycle FROM g
    UNION ALL SELECT other, 'first', CASE WHEN bool_or(NOT eq AND single) THEN 'disagree' ELSE 'agree' END, CASE WHEN bool_or(NOT eq AND single) THEN 'DEMOTED' ELSE 'ADMITTED' END FROM j WHERE ov AND (eq OR single) GROUP BY other""")
def dual_reader(spark, sf_dir):
    c = claims(spark, sf_dir).filter("lifecycle = 'ADMITTED'")
    return relate.dual_agreement(c.filter("assertion_kind <> 'inferred'"), c.filter("assertion_kind = 'inferred'"))


@query(f"""{CLAIMS_SQL}, g AS (SELECT entity_id, max(CASE WHEN needs_review THEN 2 WHEN assertion_kind <> 'stated' THEN 1 ELSE 0 END) AS worst, string_agg(DISTINCT assertion_kind, '+' ORDER BY assertion_kind) AS methods, count(*) AS n FROM visible GROUP BY entity_id)
    SELECT entity_id, ['STRONG', 'REDUCED', 'WEAK'][worst + 1] AS quality, methods, CAST(n AS BIGINT) AS n FROM g""")
def evidence_quality(spark, sf_dir):
    g = relate.visible(claims(spark, sf_dir)).groupBy("entity_id").agg(F.max(F.expr("CASE WHEN needs_review THEN 2 WHEN assertion_kind <> 'stated' THEN 1 ELSE 0 END")).alias("worst"), F.array_join(F.array_sort(F.collect_set("assertion_kind")), "+").alias("methods"), F.count(F.lit(1)).alias("n"))
    return g.select("entity_id", F.element_at(F.array(*map(F.lit, ["STRONG", "REDUCED", "WEAK"])), F.col("worst") + 1).alias("quality"), "methods", "n")


@query(f"""{CLAIMS_SQL}, r AS (SELECT doc_id, coalesce(rev_lo, rev_hi) AS v, {duck_key('coalesce(rev_lo, rev_hi)')} AS k, needs_review FROM visible WHERE rev_kind = 'ver')
    SELECT doc_id, (SELECT v FROM r x WHERE x.doc_id = r.doc_id AND NOT x.needs_review ORDER BY k DESC, v DESC LIMIT 1) AS resolved, string_agg(DISTINCT v, ',' ORDER BY v) FILTER (needs_review) AS planned FROM r GROUP BY doc_id""")
def current_revision(spark, sf_dir):
    r = relate.visible(claims(spark, sf_dir)).filter("rev_kind = 'ver'").selectExpr("doc_id", "coalesce(rev_lo, rev_hi) AS v", "needs_review").distinct().withColumn("k", F.expr(version_key("v")))
    g = r.groupBy("doc_id").agg(F.max_by(F.when(~F.col("needs_review"), F.col("v")), F.when(~F.col("needs_review"), F.struct("k", "v"))).alias("resolved"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("needs_review"), F.col("v")))), ",").alias("planned"))
    return g.select("doc_id", "resolved", F.nullif("planned", F.lit("")).alias("planned"))


@query(f"""{CLAIMS_SQL}, sup AS (SELECT claim_id, entity_id, 'component:' || (CAST(substr(entity_id, 11) AS BIGINT) + 1) AS newer, rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc FROM visible WHERE predicate = 'requires_state' AND NOT needs_review AND rev_kind = 'ver'),
    h AS (SELECT entity_id AS mention, claim_id, '<' || rev_lo AS scope FROM sup WHERE rev_lo IS NOT NULL UNION ALL SELECT newer, claim_id, {duck_describe()} FROM sup)
    SELECT mention, arg_max(scope, claim_id || scope) AS scope, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY mention""")
def scope_propagation(spark, sf_dir):
    sup = _other_end(relate.visible(claims(spark, sf_dir))).filter("predicate = 'requires_state' AND NOT needs_review AND rev_kind = 'ver'").withColumn("text", F.expr(scope.describe()))
    h = sup.selectExpr("claim_id", "inline(filter(array(named_struct('mention', entity_id, 'scope', concat('<', rev_lo)), named_struct('mention', value_id, 'scope', text)), x -> x.scope IS NOT NULL))")
    return h.groupBy("mention").agg(F.max_by("scope", F.concat("claim_id", "scope")).alias("scope"), F.count(F.lit(1)).alias("n"))


@query(f"""{CLAIMS_SQL} SELECT claim_id, concat_ws('/', doc_id, o_orderpriority, c_name) AS source, CASE assertion_kind WHEN 'inferred' THEN 'derived' ELSE 'primary' END AS role FROM visible JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def provenance(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    c = relate.visible(claims(spark, sf_dir)).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey"))
    return c.select("claim_id", F.concat_ws("/", "doc_id", "o_orderpriority", "c_name").alias("source"), F.when(F.col("assertion_kind") == "inferred", "derived").otherwise("primary").alias("role"))


@query(f"{CLAIMS_SQL} SELECT claim_id, {duck_describe()} AS scope_text, CASE rev_kind WHEN 'any' THEN '' WHEN 'unknown' THEN '(scope not established)' ELSE CASE WHEN rev_hi IS NULL THEN 'on software revision ' || rev_lo || ' and later' WHEN rev_lo IS NULL THEN 'on software revisions before ' || rev_hi ELSE 'on software revision ' || rev_lo END END AS phrase FROM claims")
def render_scope(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_id", F.expr(scope.describe()).alias("scope_text"), F.expr(scope.phrase()).alias("phrase"))


@query(f"""{CLAIMS_SQL} SELECT claim_id, entity_id || ' ' || predicate || ' = ' || vkey AS view, tier, doc_id FROM claims WHERE claim_id IN (SELECT min(claim_id) FROM claims GROUP BY entity_id)""")
def claim_lookup(spark, sf_dir):
    c = claims(spark, sf_dir)
    ids = c.groupBy("entity_id").agg(F.min("claim_id").alias("claim_id")).select("claim_id")
    return c.join(ids, "claim_id", "left_semi").select("claim_id", F.concat("entity_id", F.lit(" "), "predicate", F.lit(" = "), "vkey").alias("view"), "tier", "doc_id")


@query(f"""{CLAIMS_SQL}, h AS (SELECT doc_id, sha256(string_agg(claim_id || '|' || vkey || '|' || lifecycle, chr(10) ORDER BY claim_id)) AS h FROM visible GROUP BY doc_id),
    a AS (SELECT substr(sha256(doc_id), 1, 6) AS p, sha256(string_agg(doc_id || ':' || h, chr(10) ORDER BY doc_id)) AS h, count(*) AS n FROM h GROUP BY 1),
    b AS (SELECT substr(p, 1, 4) AS q, sha256(string_agg(p || ':' || h, chr(10) ORDER BY p)) AS h, sum(n) AS n FROM a GROUP BY 1), c AS (SELECT substr(q, 1, 2) AS r, sha256(string_agg(q || ':' || h, chr(10) ORDER BY q)) AS h, sum(n) AS n FROM b GROUP BY 1)
    SELECT substr(sha256(string_agg(r || ':' || h, chr(10) ORDER BY r)), 1, 16) AS store_hash, CAST(sum(n) AS BIGINT) AS documents FROM c""")
def store_hash(spark, sf_dir):
    from attestor.sources.store import content_hash

    return content_hash(relate.visible(claims(spark, sf_dir)))


POLICY_NAMES = list(POLICIES)
