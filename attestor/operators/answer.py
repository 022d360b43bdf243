"""From resolved slots to sentences, and the contract that sentences must keep."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions import quantity, scope
from attestor.functions.workers import shuffled

#: Predicates in words. Fixed values.
IN_WORDS = {
    "normal_operating_pressure": "normal operating pressure", "max_operating_temperature": "maximum operating temperature", "calibration_interval": "calibration interval", "approver": "approver", "mtbf": "mean time between failures",
    "supply_voltage": "supply voltage", "supply_phase": "supply phase count", "supply_compatibility": "supply compatibility statement", "alarm_trigger_condition": "alarm trigger condition", "alarm_possible_cause": "possible causes",
    "located_at": "location", "alarm_required_action": "required action", "requires_state": "start-up conditions", "reset_pressure_limit": "reset pressure limit",
}
#: States in words. Fixed values.
STATE_IN_WORDS = {
    "hydraulic_fluid_level": "the hydraulic fluid level must be within the normal band", "component:IV-21": "isolation valve IV-21 must be OPEN", "estop_circuit": "the emergency stop circuit must be RESET",
    "maintenance_access_panel": "the maintenance access panel must be installed (the unit must not be started with it removed)",
}


def words_for(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def name_of(entity: str) -> str:
    return f"element_at(split({entity}, ':', 2), -1)"


def value_text() -> str:
    return f"""CASE value_type WHEN 'quantity' THEN {quantity.shown('value', 'unit')} WHEN 'entity' THEN {name_of('value_id')} WHEN 'procedure' THEN concat('Shutdown Procedure ', {name_of('value_id')})
        WHEN 'condition' THEN concat(CASE cond_op WHEN '<' THEN 'below' WHEN '>' THEN 'above' WHEN '<=' THEN 'at or below' WHEN '>=' THEN 'at or above' ELSE cond_op END, ' ', {quantity.shown('cond_value', 'cond_unit')})
        WHEN 'state' THEN concat(item, ' ', v_text) WHEN 'list' THEN array_join(items, '; ') WHEN 'not_specified' THEN 'not specified' ELSE v_text END"""


def sentence() -> str:
    """SQL for a claim's sentence."""
    e, v = name_of("entity_id"), f"({value_text()})"
    where = f"IF(({scope.phrase()}) = '', '', concat(' ', {scope.phrase()}))"
    return f"""CASE predicate
        WHEN 'normal_operating_pressure' THEN concat('Normal operating (discharge) pressure for the ', {e}, ' is ', {v}, {where}, '.')
        WHEN 'requires_state' THEN concat('Before starting ', {e}, ': ', {words_for('item', STATE_IN_WORDS, "concat(item, ' ', v_text)")}, '.')
        WHEN 'alarm_trigger_condition' THEN concat({e}, ' is raised when hydraulic pressure is ', {v}, '.')
        WHEN 'reset_pressure_limit' THEN concat('Do not reset ', {e}, ' while hydraulic pressure is above ', {v}, '; a reset is only permitted below that level.')
        WHEN 'superseded_by' THEN concat({e}, ' is superseded by ', {v}, {where}, '.')
        WHEN 'is_distinct_from' THEN concat({e}, ' and ', {v}, ' are distinct components.')
        WHEN 'located_at' THEN concat({e}, ' is located at ', {v}, '.')
        WHEN 'introduced_by' THEN concat({e}, ' was introduced by ', {v}, '.')
        WHEN 'changed_by' THEN concat('The normal operating pressure change is recorded in ', {v}, '.')
        WHEN 'supported_on' THEN concat({e}, ' remains installed and supported', {where}, '.')
        WHEN 'installation_restriction' THEN concat('Do not install ', {e}, {where}, '.')
        WHEN 'release_date' THEN concat('Software revision ', {e}, ' took effect on ', {v}, '.')
        ELSE concat({words_for('predicate', IN_WORDS, 'predicate')}, ' of ', {e}, ': ', {v}, '.') END"""


def stray_numbers(sentence_col: str, allowed: str) -> str:
    """SQL: '' or the first number of a sentence that none of the allowed texts has. 200.0 allows 200 too."""
    nums = lambda x: f"regexp_extract_all({x}, '(\\\\d+(?:\\\\.\\\\d+)*)', 1)"
    harvested = f"flatten(transform({allowed}, a -> {nums('a')}))"
    both = f"concat({harvested}, transform({harvested}, n -> regexp_replace(n, '\\\\.0$', '')))"
    return f"coalesce(concat('number ', get(array_except({nums(sentence_col)}, {both}), 0)), '')"


def citation_balance(selected: DataFrame, cited: DataFrame, by: str) -> DataFrame:
    """(by, cited_not_selected, selected_not_cited) for each question or document."""
    s, c = selected.select(by, F.col("claim_id").alias("s")), cited.select(F.col(by).alias("c_by"), F.col("claim_id").alias("c"))
    j = s.join(c, (F.col(by) == F.col("c_by")) & (F.col("s") == F.col("c")), "full")
    return j.groupBy(F.coalesce(by, "c_by").alias(by)).agg(F.count_if(F.col("s").isNull()).alias("cited_not_selected"), F.count_if(F.col("c").isNull()).alias("selected_not_cited"))


def forbidden(disposed: DataFrame, reps: DataFrame) -> DataFrame:
    """Quantities that a slot excluded by a disjoint scope and no representative has: they may not be stated as fact."""
    out = disposed.filter("disposition = 'excluded: scope disjoint' AND value_type = 'quantity'").select("question_id", "predicate", "value", "unit", "vkey").distinct()
    return out.join(shuffled(reps.select("question_id", "vkey")), ["question_id", "vkey"], "left_anti").drop("vkey")


def compose(reps: DataFrame, status: DataFrame, gaps: DataFrame) -> DataFrame:
    """(question_id, status, sentences array<string>, claim_ids array<string>): the envelope of each question."""
    for name, kind in (("value_id", "string"), ("cond_op", "string"), ("cond_value", "double"), ("cond_unit", "string"), ("items", "array<string>")):
        if name not in reps.columns:
            reps = reps.withColumn(name, F.lit(None).cast(kind))
    said = reps.withColumn("text", F.expr(sentence())).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("slot_no", "predicate", "entity_id", "claim_id", "text"))).alias("s"))
    missing = gaps.groupBy("question_id").agg(F.array_sort(F.collect_list("text")).alias("g"))
    j = status.join(said, "question_id", "left").join(missing, "question_id", "left")
    keep = F.when(F.col("status") == "UNANSWERABLE", F.lit([]).cast("array<string>"))
    return j.select("question_id", "status", F.coalesce(keep, F.expr("transform(s, x -> x.text)"), F.lit([]).cast("array<string>")).alias("sentences"), F.coalesce(keep, F.expr("transform(s, x -> x.claim_id)"), F.lit([]).cast("array<string>")).alias("claim_ids"), F.coalesce("g", F.lit([]).cast("array<string>")).alias("gaps"))
