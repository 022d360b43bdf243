"""Names, aliases and mentions of entities."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestor.functions import text
from attestor.functions.workers import stored

#: Surfaces too general to name anything. Fixed values.
GENERIC = ["unit", "the unit", "system", "the system", "controller", "pump", "sensor", "valve", "hydraulic system"]
EMPTY = ["", "-", "—", "N/A", "n/a"]
#: What an identifier looks like. Fixed value.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{1,4}-\d+[A-Z]?|A\d{2})(?![A-Za-z0-9])")


def keyed(aliases: DataFrame) -> DataFrame:
    """aliases (entity_id, surface, status) with norm_key; blank surfaces go, general ones are rejected."""
    a = aliases.filter(~F.trim("surface").isin(*EMPTY)).withColumn("norm_key", F.expr(text.norm_key("surface"))).filter("norm_key <> ''")
    return a.withColumn("status", F.when(F.lower(F.trim("surface")).isin(*GENERIC), "rejected").otherwise(F.col("status")))


def collisions(keyed_aliases: DataFrame) -> DataFrame:
    """Keys that more than one entity claims: (norm_key, n_entities, first_entity). A clean register has none."""
    g = keyed_aliases.filter("status <> 'rejected'").groupBy("norm_key").agg(F.countDistinct("entity_id").alias("n_entities"), F.min("entity_id").alias("first_entity"))
    return g.filter("n_entities > 1")


def check(keyed_aliases: DataFrame) -> None:
    """Raise if two entities claim one name; the message has the first keys."""
    bad = collisions(keyed_aliases).orderBy("norm_key").limit(5).collect()
    if bad:
        raise ValueError("aliases of more than one entity: " + ", ".join(r["norm_key"] for r in bad))


def resolve(asked: DataFrame, keyed_aliases: DataFrame) -> DataFrame:
    """asked (surface, ...) with entity_id and status: exact, normalized or unresolved."""
    first = keyed_aliases.filter("status <> 'rejected'").groupBy("norm_key").agg(F.min_by(F.struct("entity_id", F.col("surface").alias("known")), "entity_id").alias("a")).select("norm_key", "a.*")
    j = asked.withColumn("norm_key", F.expr(text.norm_key("surface"))).join(first, "norm_key", "left")
    return j.withColumn("status", F.expr("CASE WHEN entity_id IS NULL THEN 'unresolved' WHEN surface = known THEN 'exact' ELSE 'normalized' END")).drop("norm_key", "known")


def closed_world_diff(subject: DataFrame, manuals: DataFrame) -> DataFrame:
    """Entities (entity_id) that the subject mentions and no manual does. An empty subject gives an empty result."""
    return subject.select("entity_id").filter("entity_id IS NOT NULL").distinct().join(manuals.select("entity_id"), "entity_id", "left_anti")


class Finder:
    """Mentions in a text: known surfaces, the longest first, then identifiers outside them, by place."""

    def __init__(self, surfaces: dict[str, str]):
        self.known = {s.lower(): e for s, e in surfaces.items()}
        longest = sorted(self.known, key=len, reverse=True)
        self.rx = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, longest)) + r")(?![A-Za-z0-9])", re.I) if longest else None
        self.keys = {re.sub("[^A-Z0-9]", "", s.upper()): e for s, e in surfaces.items()}

    def find(self, t: str | None) -> list[dict]:
        t = t or ""
        hits = [(m.start(), m.end(), m.group(0), self.known[m.group(0).lower()]) for m in (self.rx.finditer(t) if self.rx else ())]
        for m in IDENTIFIER.finditer(t):
            if not any(a <= m.start() and m.end() <= b for a, b, _, _ in hits):
                hits.append((m.start(), m.end(), m.group(0), self.keys.get(re.sub("[^A-Z0-9]", "", m.group(0).upper()))))
        return [{"at": a, "surface": s, "entity_id": e} for a, _, s, e in sorted(hits, key=lambda h: h[:2])]


def find_mentions(rows: DataFrame, text_col: str, surfaces: dict[str, str]) -> DataFrame:
    """rows with mentions array<struct<at, surface, entity_id>>. surfaces is a register of names (a dimension, read once)."""
    shared = rows.sparkSession.sparkContext.broadcast(surfaces)
    cache: dict = {}

    @F.pandas_udf("array<struct<at: int, surface: string, entity_id: string>>")
    def find(s: pd.Series) -> pd.Series:
        finder = cache.setdefault("f", Finder(shared.value))
        codes, texts = pd.factorize(s)
        found = pd.Series([*map(finder.find, texts), []], dtype=object)
        return found.iloc[codes].reset_index(drop=True)

    return rows.withColumn("mentions", find(F.col(text_col)))


#: A word with what stands before it; surfaces and texts are cut alike, so a match is literal but for case.
PIECE = "'[^a-z0-9]*[a-z0-9]+', 0"
NODE = "bigint"


def token_trie(aliases: DataFrame) -> DataFrame:
    """A dictionary as the edges of a token trie: (parent, token, child, depth, more, surface, entity_id, n_entities).

    aliases (entity_id, surface, status); general and blank surfaces go, and what isn't a letter or digit at a surface's ends.
    A node is named by the hash of its prefix, the root 0. An edge that ends a surface has it, and the entity if it is the only
    one of that surface: a surface that several entities claim names none, and n_entities tells.
    """
    cut = "regexp_replace(lower(surface), '^[^a-z0-9]+|[^a-z0-9]+$', '')"
    named = keyed(aliases).filter("status <> 'rejected'").select("entity_id", F.expr(cut).alias("surface")).filter("surface <> ''").groupBy("surface").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("e"))
    steps = named.withColumn("parts", F.expr(f"regexp_extract_all(surface, {PIECE})")).withColumn("depth", F.explode(F.expr("sequence(1, size(parts))")))
    prefix = lambda k: F.expr(f"array_join(slice(parts, 1, {k}), '')")
    steps = steps.withColumns({"child": F.xxhash64(prefix("depth")), "parent": F.when(F.col("depth") == 1, F.lit(0).cast(NODE)).otherwise(F.xxhash64(prefix("depth - 1"))), "token": F.expr("parts[depth - 1]")})
    ends = F.col("depth") == F.size("parts")
    return steps.groupBy("parent", "token", "child", "depth").agg(
        F.bool_or(~ends).alias("more"), F.max(F.when(ends, F.col("surface"))).alias("surface"), F.max(F.when(ends & (F.col("n") == 1), F.col("e"))).alias("entity_id"), F.max(F.when(ends, F.col("n"))).alias("n_entities"),
    )


def find_all(docs: DataFrame, doc_id: str, trie: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, place, n_words, surface, entity_id, n_entities, kept): every surface of the trie in every whole text.

    `place` counts the words before. All matches are given, overlapping ones too; `kept` marks those that a reader takes who goes
    from left to right and takes the longest at each place. The trie is walked by joins, a level at a time, over what is still
    alive; Spark picks their kind by size, so a dictionary may outgrow any executor. Ids should be unique; null texts have no
    matches.
    """
    trie = stored(trie, "trie")
    deepest = trie.agg(F.max("depth")).first()[0] or 0
    cut = docs.select(doc_id, F.expr(f"regexp_extract_all(lower({text_col}), {PIECE})").alias("ts"), F.expr(f"regexp_extract_all(lower({text_col}), '[a-z0-9]+', 0)").alias("ws")).filter("size(ts) > 0")
    each = f"transform(ws, (w, i) -> named_struct('place', i, 'token', w, 'rest', slice(ts, i + 2, {max(deepest - 1, 1)})))"
    alive = cut.select(doc_id, F.inline(F.expr(each))).withColumns({"node": F.lit(0).cast(NODE), "said": F.lit("")})
    found = None
    for depth in range(1, deepest + 1):
        level = trie.filter(F.col("depth") == depth).drop("depth")
        met = alive.join(level, (alive["node"] == level["parent"]) & (alive["token"] == level["token"]))
        met = stored(met.select(doc_id, "place", F.when(F.col("more"), F.col("rest")).alias("rest"), F.concat("said", alive["token"]).alias("said"), F.col("child").alias("node"), "more", "surface", "entity_id", "n_entities"), f"depth{depth}")
        # nodes are told apart by hashes: what was read must be the surface itself
        hits = met.filter("surface = said").select(doc_id, "place", F.lit(depth).alias("n_words"), "surface", "entity_id", "n_entities")
        found = hits if found is None else found.unionByName(hits)
        alive = met.filter("more").select(doc_id, "place", "node", "said", F.expr(f"get(rest, {depth - 1})").alias("token"), "rest").filter("token IS NOT NULL")
    if found is None:
        return cut.limit(0).selectExpr(doc_id, "0 AS place", "0 AS n_words", "'' AS surface", "'' AS entity_id", "0L AS n_entities", "true AS kept")
    found = stored(found, "mentions")
    longest = found.groupBy(doc_id, "place").agg(F.max("n_words").alias("n_words"))
    before = Window.partitionBy(doc_id).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # matches that hang together by overlaps; in each such run a fold takes the leftmost, then the next one behind it
    runs = longest.withColumn("fresh", F.coalesce(F.col("place") >= F.max(F.col("place") + F.col("n_words")).over(before), F.lit(True)))
    runs = runs.withColumn("run", F.count_if("fresh").over(Window.partitionBy(doc_id).orderBy("place"))).groupBy(doc_id, "run").agg(F.array_sort(F.collect_list(F.struct("place", "n_words"))).alias("ms"))
    take = "aggregate(ms, named_struct('end', 0, 'taken', cast(array() AS array<struct<place: int, n_words: int>>)), (a, m) -> IF(m.place >= a.end, named_struct('end', m.place + m.n_words, 'taken', array_append(a.taken, m)), a), a -> a.taken)"
    taken = runs.select(F.col(doc_id).alias("own"), F.inline(F.expr(take)))
    on = found[doc_id].eqNullSafe(taken["own"]) & (found["place"] == taken["place"]) & (found["n_words"] == taken["n_words"])
    return found.join(taken.withColumn("yes", F.lit(True)), on, "left").select(found[doc_id], found["place"], found["n_words"], "surface", "entity_id", "n_entities", F.coalesce("yes", F.lit(False)).alias("kept"))
