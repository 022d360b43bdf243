"""Text functions as SQL expressions."""

#: Curly quotes and the no-break space, and what they become. Fixed values.
FANCY, PLAIN = "\u2018\u2019\u201c\u201d\u00a0", "''\"\" "
#: Python's white space, named so that the JVM and others agree.
SPACE = "[\\\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def normalize(s: str) -> str:
    quoted = FANCY.replace("'", "''"), PLAIN.replace("'", "\\'")
    return f"trim(regexp_replace(translate({s}, '{quoted[0]}', '{quoted[1]}'), '{SPACE}+', ' '))"


def norm_key(s: str) -> str:
    return f"regexp_replace(upper({s}), '[^A-Z0-9]', '')"


def strip_parens(s: str) -> str:
    return rf"regexp_replace({s}, '\\([^)]*\\)', ' ')"


def sentences(s: str) -> str:
    return rf"split({s}, '(?<=[.!?])\\s+')"


def numbers(s: str) -> str:
    return rf"regexp_extract_all({s}, '(\\d+(?:\\.\\d+)*)', 1)"


def search_tokens(s: str) -> str:
    return f"filter(regexp_extract_all({s}, '([A-Za-z0-9]+)', 1), x -> length(x) > 1)"


def bm25_tokens(s: str) -> str:
    return rf"regexp_extract_all(lower({s}), '([a-z0-9][a-z0-9.\\-]*)', 1)"
