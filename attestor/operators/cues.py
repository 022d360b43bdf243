"""Version-scope cues in sentences, where each stands: nested ones are dropped, repeats folded, the order kept."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of cues. Fixed values.
NUMBER = r"(\d+(?:\.\d+)*)"
REVISION = r"(?:software\s+|firmware\s+|controller\s+firmware\s+)?(?:revisions?|rev\.?|firmware)"
GRAMMAR = [
    ("below", r"(?:prior\s+to|before|older\s+than|earlier\s+than)\s+(?:" + REVISION + r"\s+)?" + NUMBER),
    ("both", REVISION + r"\s+" + NUMBER + r"\s+and\s+" + NUMBER + r"\s+only"),
    ("above", REVISION + r"\s+" + NUMBER + r"\s+(?:and|or)\s+(?:later|above|newer)"),
    ("above", r"(?:as\s+of|from|effective|starting\s+(?:at|with))\s*:?\s+(?:" + REVISION + r"\s+)?" + NUMBER),
    ("above", r">=\s*" + NUMBER),
]
#: A number with a unit is no version: the one deviation from the grammar's plain reading.
NO_UNIT = r"(?!\.?\d)(?!\s*(?:bar|MPa|psi|VDC|VAC|V|mA|seconds?|sec|s|months?|°\s?C)\b)"
COMPILED = [(kind, re.compile(p + NO_UNIT, re.I)) for kind, p in GRAMMAR]
TYPE = "array<struct<lo: string, hi: string, lo_inc: boolean, hi_inc: boolean>>"


def interval(kind: str, numbers: tuple) -> dict:
    if kind == "below":
        return {"lo": None, "hi": numbers[0], "lo_inc": True, "hi_inc": False}
    if kind == "above":
        return {"lo": numbers[0], "hi": None, "lo_inc": True, "hi_inc": False}
    return {"lo": numbers[0], "hi": numbers[1], "lo_inc": True, "hi_inc": True}


def cues_of(sentence: str | None) -> list[dict]:
    found = sorted(((m.start(), -m.end(), kind, m.groups()) for kind, rx in COMPILED for m in rx.finditer(sentence or "")), key=lambda h: h[:2])
    out, reach = [], -1
    for start, minus_end, kind, numbers in found:
        if -minus_end <= reach:  # inside one that began no later
            continue
        reach = -minus_end
        cue = interval(kind, numbers)
        if cue not in out:
            out.append(cue)
    return out


def cue_array(sentence: Column) -> Column:
    @F.pandas_udf(TYPE)
    def cues(s: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(s)  # each distinct text of a batch once; null is -1
        found = pd.Series([*map(cues_of, texts), []], dtype=object)
        return found.iloc[codes].reset_index(drop=True)

    return cues(sentence)
