"""Quantities with units: parsing, conversion to one unit a dimension, comparison and display, as SQL expressions."""

#: Spelling of a unit (lower case, blanks removed): (unit, dimension, factor to the dimension's own unit). Fixed values.
UNITS = {
    "bar": ("bar", "pressure", 1.0), "mpa": ("bar", "pressure", 10.0), "psi": ("bar", "pressure", 0.06894757293168361),
    "v": ("volt", "voltage", 1.0), "vdc": ("volt", "voltage", 1.0), "vac": ("volt", "voltage", 1.0), "volt": ("volt", "voltage", 1.0), "volts": ("volt", "voltage", 1.0),
    "ma": ("milliampere", "current", 1.0), "s": ("second", "time", 1.0), "sec": ("second", "time", 1.0), "second": ("second", "time", 1.0), "seconds": ("second", "time", 1.0),
    "month": ("second", "time", 2629800.0), "months": ("second", "time", 2629800.0), "°c": ("degC", "temperature", 1.0), "c": ("degC", "temperature", 1.0),
}
#: Number and unit as they stand in text; no letter may follow. Fixed value.
PATTERN = r"(-?\\d+(?:\\.\\d+)?)\\s*(bar|MPa|psi|VDC|VAC|V|mA|seconds?|sec|s|months?|°\\s?C)(?![A-Za-z])"
SHOWN = {"degC": "°C", "volt": "V", "second": "s"}


def _lookup(u: str, i: int) -> str:
    key = f"lower(replace({u}, ' ', ''))"
    value = (lambda v: f"'{v}'") if i < 2 else (lambda v: f"{v!r}D")
    return f"element_at(map({', '.join(f"'{k}', {value(v[i])}" for k, v in UNITS.items())}), {key})"


def unit_of(u: str) -> str:
    return _lookup(u, 0)


def dimension_of(u: str) -> str:
    return _lookup(u, 1)


def in_own_unit(value: str, u: str) -> str:
    """SQL for the value in its dimension's own unit, to 6 digits; unknown units as they are."""
    return f"round({value} * coalesce({_lookup(u, 2)}, 1D), 6)"


def parse(s: str) -> str:
    """SQL for an array of STRUCT<value, unit>, one for each quantity in a text, in order."""
    return f"""transform(arrays_zip(regexp_extract_all({s}, '{PATTERN}', 1), regexp_extract_all({s}, '{PATTERN}', 2)),
        q -> named_struct('value', {in_own_unit('cast(q.`0` AS DOUBLE)', 'q.`1`')}, 'unit', {unit_of('q.`1`')}))"""


def equal(a: str, b: str, a_unit: str, b_unit: str, tol: float = 1e-6) -> str:
    return f"({a_unit} = {b_unit} AND abs({a} - {b}) <= {tol!r}D * greatest(1D, abs({a})))"


def shown(value: str, unit: str) -> str:
    name = f"CASE {unit} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SHOWN.items()) + f" ELSE {unit} END"
    return f"concat(IF({value} = floor({value}), cast(cast({value} AS BIGINT) AS STRING), cast({value} AS STRING)), ' ', {name})"
