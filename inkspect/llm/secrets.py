"""Secret scan with a trigram index, in DataFrame functions only.

Each rule's expression gives a Boolean trigram query. Posting lists (trigram, row) hold the
trigrams that any rule asks for, over whole texts. Intersecting and uniting them, as
counts per row and alternative, gives each rule's candidates, and only these are
matched against the expression. Rules without mandatory trigrams scan every text.

Offsets are code points with an exclusive end. They come from running sums over the
pieces between matches, so a text with very many matches takes linear time.

Defined cases: a null text counts as empty; repeated rows and null ids give a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkspect.llm.common import id_text, joined_small, row_key
from inkspect.llm.trigrams import trigram_query
from inkspect.session import staged


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # characters that it must have
    base: bool = False


# The base kinds in their order. A run of hexadecimal digits is matched from
# 24 on, which gives the same spans as matching all runs and dropping the shorter ones.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
]
# Public formats of further secrets.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES


def postings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Inverted index (trigram, rk) of an (id, rk, text) table, for the trigrams that the rules ask for."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.pattern) for conj in clause for t in conj})
    low = docs.filter("text is not null").select("rk", F.lower("text").alias("low"))
    terms = F.array(*(F.lit(t) for t in wanted)) if wanted else F.array().cast("array<string>")
    return low.select("rk", F.explode(F.filter(terms, lambda t: F.contains(F.col("low"), t))).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (rk, kinds): the rules whose trigram query holds in the index."""
    spark = index.sparkSession
    plan = [
        (r.kind, c, a, len(conj), len(query), t)
        for r in rules
        for query in [trigram_query(r.pattern)]
        for c, clause in enumerate(query)
        for a, conj in enumerate(clause)
        for t in sorted(conj)
    ]
    # As small as the rules: a row for each trigram of an alternative.
    asked = spark.createDataFrame(plan, "kind string, clause int, alternative int, terms int, clauses int, trigram string")
    met = index.join(F.broadcast(asked), "trigram").groupBy("rk", "kind", "clause", "alternative").agg(
        F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms"), F.first("clauses").alias("clauses")
    )
    met = met.filter("n = terms").groupBy("rk", "kind").agg(F.count_distinct("clause").alias("n"), F.first("clauses").alias("clauses"))
    return met.filter("n = clauses").groupBy("rk").agg(F.collect_set("kind").alias("kinds"))


def spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (rk, number, kind, start, stop) of an (id, rk, text) table; number is the rule's place in the list."""
    found = staged(candidates(staged(postings(docs, rules), "trigrams"), rules), "candidates")
    texts = docs.filter("text is not null").select("rk", "text")
    narrowed = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    scanned = [(i, r) for i, r in enumerate(rules) if not trigram_query(r.pattern)]

    def matches(i: int, r: Rule):
        hit = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        return F.struct(
            F.lit(i).alias("number"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), F.lit(r.pattern).alias("pattern"),
            hit.alias("whole"), (F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else hit).alias("part"),
        )

    parts = []
    if narrowed:
        asked = joined_small(texts, found, "rk", "inner", found.count())
        parts.append(asked.select("rk", "text", F.explode(F.array(*(F.when(F.array_contains("kinds", r.kind), matches(i, r)) for i, r in narrowed))).alias("m")))
    for i, r in scanned:
        parts.append(texts.filter(F.col("text").rlike(r.pattern)).select("rk", "text", matches(i, r).alias("m")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.filter("m is not null and size(m.whole) > 0").withColumn("number", F.col("m.number")).dropDuplicates(["rk", "number"])
    pieces = F.slice(F.split("text", F.col("m.pattern"), -1), 1, F.size("m.whole"))
    rows = hits.select("rk", "m.number", "m.kind", "m.least", F.posexplode(F.arrays_zip(pieces.alias("gap"), F.col("m.whole").alias("whole"), F.col("m.part").alias("part"))).alias("i", "z"))
    running = F.sum(F.length("z.gap") + F.length("z.whole")).over(Window.partitionBy("rk", "number").orderBy("i"))
    rows = rows.select("rk", "number", "kind", "least", F.length("z.part").alias("size"), running.alias("stop"), F.length("z.whole").alias("width"))
    return rows.filter("size >= least").select("rk", "number", "kind", (F.col("stop") - F.col("width")).alias("start"), "stop")


def report(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The contract's digest of an (doc_id, text) table."""
    rows = id_text(docs).withColumn("rk", row_key(F.col("id"), F.col("text")))
    order = F.struct("start", "number", F.concat_ws(":", "kind", "start", "stop").alias("span"))
    base = [r.kind for r in rules if r.base]
    per = spans(rows, rules).groupBy("rk").agg(
        *(F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in base),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(base), order))).alias("own"),
        F.sort_array(F.collect_list(order)).alias("all"),
    )
    per = staged(per.select("rk", *(f"n_{k}" for k in base), F.array_join("own.span", ",").alias("own"), F.array_join("all.span", ",").alias("all")), "spans")
    out = joined_small(rows.select("id", "rk"), per, "rk", "left", per.count())
    return out.select(
        F.col("id").alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"),
    )


def sql(rules: list[Rule] = RULES) -> str:
    def one(i: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        return (
            f"SELECT doc_id, {i} AS number, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, "
            f"regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS g, "
            f"string_split_regex(text, '{p}') AS s FROM documents WHERE regexp_matches(text, '{p}')"
        )

    return (
        "WITH hit AS (" + " UNION ALL ".join(one(i, r) for i, r in enumerate(rules)) + "),\n"
        "span AS (SELECT doc_id, number, kind, base, least, length(g[i]) AS size, length(m[i]) AS width,\n"
        "  list_sum(list_transform(s[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop\n"
        "  FROM hit, UNNEST(range(1, len(m) + 1)) AS t(i)),\n"
        "ok AS (SELECT *, CAST(stop - width AS BIGINT) AS start, kind || ':' || CAST(stop - width AS BIGINT) || ':' || CAST(stop AS BIGINT) AS txt\n"
        "  FROM span WHERE size >= least),\n"
        "per AS (SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
        + ", string_agg(txt, ',' ORDER BY start, number) FILTER (base) AS own, string_agg(txt, ',' ORDER BY start, number) AS spans FROM ok GROUP BY doc_id)\n"
        "SELECT d.doc_id, "
        + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
        + ", sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per USING (doc_id)"
    )
