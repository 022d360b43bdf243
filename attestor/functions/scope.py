"""The scope algebra as SQL expressions over flat columns.

A revision scope is (rev_kind, rev_lo, rev_hi, rev_lo_inc, rev_hi_inc, lo_k, hi_k), rev_kind being any, unknown or ver;
a sensor or line scope is (x_kind, x_ids), x_kind being any, unknown or ent. UNKNOWN is a value of its own and never NULL:
a definite separation wins over it, and it wins over overlap.
"""


def rev_disjoint(a: str, b: str) -> str:
    """SQL: the two intervals have no version in common."""

    def past(x: str, y: str) -> str:
        return f"coalesce({x}lo_k > {y}hi_k OR ({x}lo_k = {y}hi_k AND NOT ({x}rev_lo_inc AND {y}rev_hi_inc)), false)"

    return f"({past(a, b)} OR {past(b, a)})"


def rev_relation(a: str, b: str) -> str:
    return f"""CASE WHEN {a}rev_kind = 'unknown' OR {b}rev_kind = 'unknown' THEN 'UNKNOWN'
        WHEN {a}rev_kind = 'any' OR {b}rev_kind = 'any' THEN 'OVERLAP'
        WHEN {rev_disjoint(a, b)} THEN 'DISJOINT' ELSE 'OVERLAP' END"""


def set_relation(a: str, b: str, dim: str) -> str:
    return f"""CASE WHEN {a}{dim}_kind = 'unknown' OR {b}{dim}_kind = 'unknown' THEN 'UNKNOWN'
        WHEN {a}{dim}_kind = 'any' OR {b}{dim}_kind = 'any' THEN 'OVERLAP'
        WHEN arrays_overlap({a}{dim}_ids, {b}{dim}_ids) THEN 'OVERLAP' ELSE 'DISJOINT' END"""


def combine(*relations: str) -> str:
    arr = f"array({', '.join(relations)})"
    return f"CASE WHEN array_contains({arr}, 'DISJOINT') THEN 'DISJOINT' WHEN array_contains({arr}, 'UNKNOWN') THEN 'UNKNOWN' ELSE 'OVERLAP' END"


def scope_relation(a: str = "a.", b: str = "b.", sets: tuple[str, ...] = ("sensor",)) -> str:
    """OVERLAP, DISJOINT or UNKNOWN over all dimensions."""
    return combine(rev_relation(a, b), *[set_relation(a, b, d) for d in sets])


def describe(p: str = "") -> str:
    """SQL for the text of a revision scope."""
    lo, hi, li, hi_inc = f"{p}rev_lo", f"{p}rev_hi", f"{p}rev_lo_inc", f"{p}rev_hi_inc"
    return f"""CASE WHEN {p}rev_kind <> 'ver' THEN {p}rev_kind
        WHEN {lo} = {hi} AND {li} AND {hi_inc} THEN concat('=', {lo})
        WHEN {lo} IS NOT NULL AND {hi} IS NULL THEN concat(IF({li}, '≥', '>'), {lo})
        WHEN {hi} IS NOT NULL AND {lo} IS NULL THEN concat(IF({hi_inc}, '≤', '<'), {hi})
        WHEN {lo} IS NOT NULL THEN concat(IF({li}, '[', '('), {lo}, ', ', {hi}, IF({hi_inc}, ']', ')'))
        ELSE 'all versions' END"""


def phrase(p: str = "") -> str:
    """SQL for a revision scope in a sentence."""
    return f"""CASE WHEN {p}rev_kind = 'any' THEN '' WHEN {p}rev_kind = 'unknown' THEN '(scope not established)'
        WHEN {p}rev_lo IS NOT NULL AND {p}rev_hi IS NULL THEN concat('on software revision ', {p}rev_lo, ' and later')
        WHEN {p}rev_hi IS NOT NULL AND {p}rev_lo IS NULL THEN concat(IF({p}rev_hi_inc, 'on software revisions up to ', 'on software revisions before '), {p}rev_hi)
        WHEN {p}rev_lo = {p}rev_hi THEN concat('on software revision ', {p}rev_lo)
        ELSE concat('on software revisions ', {p}rev_lo, ' to ', {p}rev_hi) END"""


def meet(a: str, b: str) -> str:
    """SQL for the narrowing of two revision scopes: STRUCT<kind, lo, hi, lo_inc, hi_inc>, NULL where nothing is left."""
    lo_b = f"({b}lo_k IS NOT NULL AND ({a}lo_k IS NULL OR {b}lo_k > {a}lo_k OR ({b}lo_k = {a}lo_k AND NOT {b}rev_lo_inc)))"
    hi_b = f"({b}hi_k IS NOT NULL AND ({a}hi_k IS NULL OR {b}hi_k < {a}hi_k OR ({b}hi_k = {a}hi_k AND NOT {b}rev_hi_inc)))"

    def whole(p: str) -> str:
        return f"named_struct('kind', {p}rev_kind, 'lo', {p}rev_lo, 'hi', {p}rev_hi, 'lo_inc', {p}rev_lo_inc, 'hi_inc', {p}rev_hi_inc)"

    return f"""CASE WHEN {a}rev_kind = 'unknown' OR {b}rev_kind = 'unknown' THEN named_struct('kind', 'unknown', 'lo', cast(NULL AS STRING), 'hi', cast(NULL AS STRING), 'lo_inc', true, 'hi_inc', false)
        WHEN {a}rev_kind = 'any' THEN {whole(b)} WHEN {b}rev_kind = 'any' THEN {whole(a)}
        WHEN {rev_disjoint(a, b)} THEN NULL
        ELSE named_struct('kind', 'ver', 'lo', IF({lo_b}, {b}rev_lo, {a}rev_lo), 'hi', IF({hi_b}, {b}rev_hi, {a}rev_hi),
                          'lo_inc', IF({lo_b}, {b}rev_lo_inc, {a}rev_lo_inc), 'hi_inc', IF({hi_b}, {b}rev_hi_inc, {a}rev_hi_inc)) END"""


def contains_strictly(o: str, i: str) -> str:
    """SQL: scope o is wider than scope i. Bounds are compared as versions, so 3.2 and 3.2.0 are one."""
    same_lo = f"({o}lo_k <=> {i}lo_k AND ({o}lo_k IS NULL OR {o}rev_lo_inc = {i}rev_lo_inc))"
    same_hi = f"({o}hi_k <=> {i}hi_k AND ({o}hi_k IS NULL OR {o}rev_hi_inc = {i}rev_hi_inc))"
    lo_in = f"({o}lo_k IS NULL OR coalesce({i}lo_k > {o}lo_k OR ({i}lo_k = {o}lo_k AND ({o}rev_lo_inc OR NOT {i}rev_lo_inc)), false))"
    hi_in = f"({o}hi_k IS NULL OR coalesce({i}hi_k < {o}hi_k OR ({i}hi_k = {o}hi_k AND ({o}rev_hi_inc OR NOT {i}rev_hi_inc)), false))"
    return f"""(CASE WHEN {o}rev_kind = 'any' THEN {i}rev_kind <> 'any'
        WHEN {o}rev_kind = 'ver' AND {i}rev_kind = 'ver' THEN {lo_in} AND {hi_in} AND NOT ({same_lo} AND {same_hi}) ELSE false END)"""
