"""URL filters: allow and block rules over host suffixes and path prefixes.

Each distinct (host, path) is expanded into every host suffix x every path prefix whose number of labels, and length, some
rule has. The
expressions meet the rules in an equi-join on the first hex digits of their SHA-256; equal full digests confirm, and the
longest rule wins (then the longer host, then block). Expressions of equal urls are folded before the exchange.

Defined results: a null url, or one without "://", has empty host and path and the default verdict; a url without a path
has an empty path, which no rule with a path fits; repeated rows come back as often as they were given.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ascii_lower, table

#: (verdict, host, path) of the rules that the query applies. Fixed values.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
PREFIX_HEX = 8
#: Up to so many rules (some 10 MB) are sent to all executors; a longer list is shuffled like any table.
MOST_BROADCAST = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark, rules) -> DataFrame:
    rows = []
    for verdict, host, path in rules:
        digest = hashlib.sha256((host + path).encode()).hexdigest()
        rows.append((digest[:PREFIX_HEX], digest, host + path, len(host), verdict))
    return spark.createDataFrame(rows, "prefix string, digest string, rule string, host_len int, verdict string")


def judge(pages: DataFrame, rules=None, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages."""
    rules = RULES if rules is None else rules
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    depths = ", ".join(map(str, sorted({h.count(".") + 1 for _, h, _ in rules}))) or "0"  # of hosts that some rule has
    suffixes = F.expr(f"transform(filter(array({depths}), n -> n <= size(labels)), n -> array_join(slice(labels, size(labels) - n + 1, n), '.'))")
    lens = ", ".join(map(str, lengths)) or "0"
    prefixes = F.expr(f"transform(filter(array({lens}), n -> n <= char_length(path)), n -> substring(path, 1, n))")
    wide = base.withColumn("labels", labels).withColumn("suffixes", suffixes).withColumn("prefixes", prefixes)
    # element 0 is no expression: it keeps urls that no rule fits, and counts repeated rows
    spread = wide.select("page_id", "host", "path", F.explode(F.expr("concat(array(cast(null as string)), flatten(transform(suffixes, s -> transform(prefixes, p -> sha2(concat(s, p), 256)))))")).alias("full"))
    spread = spread.withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    table_ = rule_table(pages.sparkSession, rules)
    if len(rules) <= MOST_BROADCAST:
        table_ = F.broadcast(table_)
    met = spread.join(table_, "prefix", "left").filter(F.col("full").isNull() | (F.col("full") == F.col("digest")))
    order = F.struct(F.length("rule"), F.col("host_len"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    hit = F.col("digest").isNotNull()
    best = met.groupBy("page_id", "host", "path").agg(F.max_by(F.when(hit, F.struct("rule", "verdict")), F.when(hit, order)).alias("best"), F.count_if(F.col("full").isNull()).alias("rows"))
    best = best.withColumn("again", F.explode(F.expr("sequence(1L, rows)")))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
