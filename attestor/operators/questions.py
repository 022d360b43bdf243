"""Question analysis: ordered rules, the first that fits wins. Rules are a table; the chain is one expression over all questions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rule: (pattern, further pattern or None, kinds of entity needed, how many, intent, policy, predicates). Fixed values.
RULES = [
    ("mtbf", r"mean time between failures|\bMTBF\b", None, "", 0, "PARAMETER_QUERY", "PARAMETER", ["mtbf"]),
    ("calibration_interval", r"calibration interval|recalibration (?:interval|frequency)", None, "", 0, "PARAMETER_QUERY", "PARAMETER", ["calibration_interval"]),
    ("max_temperature", r"(?:maximum|max)\b.*temperature|temperature (?:limit|rating)", None, "", 0, "PARAMETER_QUERY", "PARAMETER", ["max_operating_temperature"]),
    ("approver", r"who approved|approved by|\bapprover\b|who signed off", None, "", 0, "FIELD_LOOKUP", "PARAMETER", ["approver"]),
    ("supply_compatibility", r"compatib", r"supply|volt|phase|\d+\s*V\b", "", 0, "COMPATIBILITY_QUERY", "PARAMETER", ["supply_voltage", "supply_phase", "supply_compatibility"]),
    ("topology", r"connect(?:s|ed)? directly|directly connect", None, "", 0, "DIAGRAM_TOPOLOGY", "TOPOLOGY", ["connects_to_control_signal"]),
    ("diff", r"introduce any component|not found in the manuals|new component|new alarm", None, "", 0, "CROSS_DOCUMENT_DIFF", "DIFF", ["introduces_component", "introduces_alarm"]),
    ("artifact_tag", r"screenshot|screen\b", r"sensor id|tag|id appears", "screen", 1, "IDENTITY_FROM_IMAGE", "ARTIFACT", ["displays_tag", "matches_entity"]),
    ("key_mapping", r"\bsensor_\w+|configuration export.*correspond|config key", None, "", 0, "KEY_MAPPING", "KEY_MAPPING", ["config_key_maps_to"]),
    ("revision_history", r"take effect|took effect|release date|revision history|when did software revision", None, "software_revision", 1, "TABLE_LOOKUP", "HISTORY", ["release_date", "change_summary"]),
    ("introduced_by", r"which document introduced|introduced the change|what introduced", None, "", 0, "PROVENANCE_LOOKUP", "HISTORY", ["introduced_by"]),
    ("identity", r"same (?:component|sensor|part)?\s*as|the same|identical to|same thing", None, "component", 2, "IDENTITY", "IDENTITY", ["is_distinct_from"]),
    ("alarm_reverse", r"which alarm.*?(?:below|above|under|over)\s+\d+\s*bar", None, "", 0, "ALARM_LOOKUP_REVERSE", "PARAMETER", ["alarm_trigger_condition"]),
    ("alarm_action", r"persist|what action|required action|should .* do|respond", None, "alarm", 1, "PROCEDURE_LOOKUP", "SAFETY_PROCEDURE", ["alarm_required_action"]),
    ("alarm_meaning", r"indicate|mean|cause|what is alarm|what does", None, "alarm", 1, "ALARM_LOOKUP", "SAFETY_PROCEDURE", ["alarm_trigger_condition", "alarm_possible_cause"]),
    ("location", r"location of|where is|where are|located", None, "component alarm", 1, "REGISTER_LOOKUP", "PARAMETER", ["located_at"]),
    ("reset", r"\breset\b", None, "", 0, "SAFETY_CONSTRAINT", "SAFETY_PROCEDURE", ["reset_pressure_limit"]),
    ("startup", r"before starting|before (?:you )?start|before I start|what has to be true|must be true before|startup (?:requirement|condition|interlock|check)|start-up checks?|prerequisite", None, "", 0, "PRECONDITION_LIST", "SAFETY_PROCEDURE", ["requires_state"]),
    ("applicability", r"apply to all|only some|apply to (?:every|all)|which units|all units", r"threshold|pressure|setpoint|\d+\s*bar", "", 0, "SCOPE_QUERY", "PARAMETER", ["applicability_scope"]),
    ("flash_point", r"flash point|flash-point", r"fluid", "", 0, "PARAMETER_QUERY", "PARAMETER", ["flash_point"]),
    ("introduced_revision", r"revision.*introduc", None, "", 0, "HISTORY", "HISTORY", ["requires_software_revision"]),
    ("supply", r"supply voltage|incoming.*supply|electrical supply", None, "", 0, "COMPATIBILITY_QUERY", "PARAMETER", ["supply_voltage"]),
    ("alarm_action_paraphrase", r"stays? active|remains active|clears? by itself|clears? automatically|longer than|more than", None, "alarm", 1, "PROCEDURE_LOOKUP", "SAFETY_PROCEDURE", ["alarm_required_action"]),
    ("pressure", r"operating pressure|pressure (?:limit|threshold|setpoint)|discharge pressure|normal pressure|pressure.*(?:before|prior)|normal running|normally run|should .* reach.*pressure|reach.*during normal", None, "", 0, "PARAMETER_QUERY_WITH_SCOPE", "PARAMETER", ["normal_operating_pressure"]),
]
#: Slots that a question of a rule has besides, if it also fits the pattern: (rule, pattern, predicate). Fixed values.
MORE_SLOTS = [
    ("supply", r"phase", "supply_phase"), ("supply", r"compatib", "supply_compatibility"),
    ("pressure", r"conditions|when does", "applicability_scope"), ("pressure", r"what changed|changed it|why did .* change|what caused", "changed_by"),
]
#: Rules whose missing entity makes the question unanswerable, and the entity that others fall back to. Fixed values.
NEED_TARGET = {"mtbf": "component", "calibration_interval": "component", "max_temperature": "component", "approver": "document", "diff": "document", "key_mapping": "config", "introduced_by": "component", "introduced_revision": "component"}
FALLBACK = {"topology": "component:PLC-03", "reset": "component:PLC-03", "startup": "component:HPU", "applicability": "component:HPU", "pressure": "component:HPU", "flash_point": "material:HydroFluid-32"}
ALWAYS_OWN = ("applicability", "flash_point", "pressure")
CURRENT = r"(?i)\b(current|currently|now|latest|today)\b"


def of_kind(kinds: str, mentioned: str = "mentioned") -> str:
    listed = ", ".join(f"'{k}'" for k in kinds.split())
    return f"filter({mentioned}, m -> split(m, ':')[0] IN ({listed}))"


def _fits(rule) -> Column:
    _, pattern, further, kinds, needed, *_ = rule
    c = F.col("question").rlike(f"(?i){pattern}")
    if further:
        c &= F.col("question").rlike(f"(?i){further}")
    if needed:
        c &= F.expr(f"size({of_kind(kinds)}) >= {needed}")
    return c


def intents(questions: DataFrame) -> DataFrame:
    """questions (question_id, question, mentioned array<entity_id>) with rule, intent, policy and predicates."""
    spec = F.coalesce(*[F.when(_fits(r), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[5]).alias("intent"), F.lit(r[6]).alias("policy"), F.array(*map(F.lit, r[7])).alias("predicates"))) for r in RULES], F.struct(F.lit("none").alias("rule"), F.lit("UNKNOWN").alias("intent"), F.lit("PARAMETER").alias("policy"), F.lit([]).cast("array<string>").alias("predicates")))
    q = questions.withColumn("spec", spec).select("*", "spec.*").drop("spec")
    more = F.array_compact(F.array(*[F.when((F.col("rule") == rule) & F.col("question").rlike(f"(?i){p}"), F.lit(pred)) for rule, p, pred in MORE_SLOTS]))
    return q.withColumn("predicates", F.concat("predicates", more)).withColumn("asks_current", F.col("question").rlike(CURRENT))


def slots(analyzed: DataFrame) -> DataFrame:
    """A row for each slot of analyzed questions, with scope columns from cue (struct lo, hi, lo_inc, hi_inc or null).

    unresolved: the question names no entity of the kind its rule needs.
    """
    kind = "CASE rule " + " ".join(f"WHEN '{r}' THEN {of_kind(k)}" for r, k in NEED_TARGET.items()) + f" WHEN 'artifact_tag' THEN {of_kind('screen')} WHEN 'revision_history' THEN {of_kind('software_revision')} WHEN 'identity' THEN slice({of_kind('component')}, 1, 2)"
    kind += "".join(f" WHEN '{r}' THEN slice({of_kind('alarm')}, 1, 1)" for r in ("alarm_action", "alarm_meaning", "alarm_action_paraphrase"))
    kind += f" WHEN 'location' THEN slice({of_kind('component alarm')}, 1, 1)" + "".join(f" WHEN '{r}' THEN slice({of_kind('component')}, 1, 1)" for r in ("topology", "reset", "startup")) + " ELSE cast(array() AS array<string>) END"
    default = "CASE rule " + " ".join(f"WHEN '{r}' THEN array('{e}')" for r, e in FALLBACK.items()) + " ELSE cast(array() AS array<string>) END"
    one = ", ".join(f"'{r}'" for r in ("mtbf", "calibration_interval", "max_temperature", "approver", "key_mapping", "diff"))
    a = analyzed.withColumn("own", F.expr(kind)).withColumn("own", F.expr(f"IF(rule IN ({one}), slice(own, 1, 1), own)"))
    a = a.withColumn("entities", F.expr(f"IF(rule IN {ALWAYS_OWN} OR size(own) = 0, {default}, own)"))
    need = ", ".join(f"'{r}'" for r in NEED_TARGET)
    a = a.withColumn("unresolved", F.expr(f"rule IN ({need}) AND size(own) = 0"))
    a = a.select("*", F.posexplode("predicates").alias("slot_no", "predicate"))
    reverse = r"(?i)which alarm.*?(below|above|under|over)\\s+(\\d+)\\s*bar"
    return a.selectExpr(
        "question_id", "slot_no", "predicate", "entities", "rule LIKE 'supply%' AS system", "IF(rule = 'identity', own, NULL) AS pair",
        f"IF(rule = 'alarm_reverse', IF(lower(regexp_extract(question, '{reverse}', 1)) IN ('below', 'under'), '<', '>'), NULL) AS op", f"IF(rule = 'alarm_reverse', cast(regexp_extract(question, '{reverse}', 2) AS DOUBLE), NULL) AS qty", "IF(rule = 'alarm_reverse', 'bar', NULL) AS unit",
        "policy", "true AS required", "rule", "asks_current", "cue", "unresolved",
    )
