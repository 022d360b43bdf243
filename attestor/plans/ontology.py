"""The closed world: predicates, admission policies and orders. Fixed values, stated as tables."""

from pyspark.sql import DataFrame, SparkSession

#: predicate: (subject kinds, value types, dimension of a quantity)
PREDICATES = {
    "requires_state": ("component system", "state", None),
    "normal_operating_pressure": ("component system", "quantity", "pressure"),
    "observed_pressure": ("component", "quantity", "pressure"),
    "applicability_scope": ("component system", "text", None),
    "alarm_trigger_condition": ("alarm", "condition", None),
    "alarm_possible_cause": ("alarm", "text", None),
    "alarm_required_action": ("alarm", "procedure text", None),
    "panel_indication": ("alarm", "enum", None),
    "alarm_note": ("alarm", "text", None),
    "evaluated_against": ("alarm", "text", None),
    "prohibited_action": ("alarm component", "text", None),
    "procedure_steps": ("procedure", "list", None),
    "reset_pressure_limit": ("component", "quantity", "pressure"),
    "reset_min_pressure": ("component", "quantity not_specified", "pressure"),
    "hazard": ("component alarm", "text", None),
    "superseded_by": ("component", "entity", None),
    "is_distinct_from": ("component", "entity", None),
    "introduced_by": ("component", "entity", None),
    "changed_by": ("component system", "entity", None),
    "active_sensor": ("component", "entity", None),
    "corresponds_to": ("component", "entity", None),
    "not_covered_in": ("component", "entity", None),
    "connects_to_control_signal": ("component", "entity", None),
    "connects_to_fluid_path": ("component", "entity", None),
    "connects_to_reservoir_interconnect": ("component", "entity", None),
    "located_at": ("component", "text", None),
    "lifecycle_status": ("component alarm", "enum", None),
    "common_name": ("component alarm", "text", None),
    "requires_software_revision": ("component", "version", None),
    "installation_restriction": ("component", "text", None),
    "supported_on": ("component", "text", None),
    "introduces_component": ("document", "entity", None),
    "introduces_alarm": ("document", "entity", None),
    "displays_tag": ("screen", "text", None),
    "matches_entity": ("screen", "entity", None),
    "release_date": ("software_revision", "date", None),
    "release_status": ("software_revision", "enum", None),
    "change_summary": ("software_revision", "text", None),
    "config_key_value": ("config", "quantity text number", None),
    "config_key_maps_to": ("config", "text", None),
    "max_operating_temperature": ("component", "quantity", "temperature"),
    "calibration_interval": ("component", "quantity not_specified", "time"),
    "approver": ("document", "person", None),
    "mtbf": ("component", "quantity", "time"),
    "supply_voltage": ("component system", "quantity text", None),
    "supply_phase": ("component system", "text", None),
    "supply_compatibility": ("component system", "text", None),
    "flash_point": ("material", "quantity", "temperature"),
    "pour_point": ("material", "quantity", "temperature"),
    "last_calibrated": ("component", "date", None),
    "calibration_reference": ("component", "quantity", "pressure"),
    "performed_by": ("component", "person", None),
    "observed_firmware": ("component", "version", None),
    "signal_type": ("component", "text", None),
    "change_rationale": ("component system document", "text", None),
    "change_reason": ("component system document", "text", None),
    "effective_from": ("document", "version text", None),
    "document_title": ("document", "text", None),
    "document_status": ("document", "enum", None),
    "references": ("document", "text", None),
    "definition": ("component alarm system software_revision", "text", None),
}
SINGLE_VALUED = [
    "normal_operating_pressure", "reset_pressure_limit", "release_date", "release_status", "located_at", "lifecycle_status", "flash_point", "pour_point",
    "config_key_value", "displays_tag", "alarm_trigger_condition", "panel_indication", "document_status", "observed_pressure", "requires_state",
]
EVENTS = ["changed_by", "introduced_by", "release_date", "change_summary", "release_status", "document_title", "document_status", "effective_from", "references"]
#: An observation of the first is an advisory for slots of the second.
FAMILY = {"observed_pressure": "normal_operating_pressure"}
#: Slots of the first are answered by claims of the second.
DERIVED_SOURCE = {"applicability_scope": "normal_operating_pressure"}
#: policy: (answer-bearing kinds, tiers that may stand alone, whether scope filters)
POLICIES = {
    "SAFETY_PROCEDURE": ("stated structural", "primary reference", True),
    "PARAMETER": ("stated structural", "primary reference", True),
    "HISTORY": ("stated structural", "primary reference", True),
    "TOPOLOGY": ("structural", "primary reference", True),
    "KEY_MAPPING": ("stated inferred structural", "primary reference", True),
    "ARTIFACT": ("stated structural", "primary reference field_observation", False),
    "IDENTITY": ("stated structural inferred", "primary reference", True),
    "DIFF": ("stated structural", "primary reference derived", True),
    "PRESENCE": ("stated structural", "primary reference", True),
}
KIND_ORDER, TIER_ORDER = ["stated", "structural", "inferred"], ["primary", "reference", "derived", "field_observation"]


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def place(column: str, order: list[str]) -> str:
    """SQL for the place of a value in an order."""
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(order)) + " END"


def predicate_table(spark: SparkSession) -> DataFrame:
    rows = [(p, k.split(), t.split(), d) for p, (k, t, d) in PREDICATES.items()]
    return spark.createDataFrame(rows, "predicate string, kinds array<string>, vtypes array<string>, dim string")


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(p, k.split(), t.split(), s) for p, (k, t, s) in POLICIES.items()]
    return spark.createDataFrame(rows, "policy string, allowed_kinds array<string>, sole_tiers array<string>, scope_filter boolean")
