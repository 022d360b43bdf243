"""Dotted versions as arrays of ints, which Spark orders the way versions are: 3.2 = 3.2.0 < 3.2.1 < 3.10."""


def version_key(v: str) -> str:
    """SQL for the comparison key of a version expression; NULL where a part is no number."""
    parts = f"transform(split(trim({v}), '[.]'), x -> try_cast(x AS INT))"
    padded = f"concat({parts}, array_repeat(0, greatest(0, 4 - size(split(trim({v}), '[.]')))))"
    return f"IF({v} IS NULL OR exists({parts}, x -> x IS NULL), NULL, {padded})"


def contains(v_key: str, lo_k: str, hi_k: str, lo_inc: str, hi_inc: str) -> str:
    """SQL: the version with key v_key lies in the interval."""
    above = f"({lo_k} IS NULL OR {v_key} > {lo_k} OR ({v_key} = {lo_k} AND {lo_inc}))"
    below = f"({hi_k} IS NULL OR {v_key} < {hi_k} OR ({v_key} = {hi_k} AND {hi_inc}))"
    return f"({above} AND {below})"
