"""The registered queries as SQL over the same tables."""

from __future__ import annotations

from inkspect.functions import lexicons as lx
from inkspect.operators import profile


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def count_class(text: str, chars: str) -> str:
    """Characters of ``text`` matching the class body ``chars``."""
    return f"(length({text}) - length(regexp_replace({text}, {lit('[' + chars + ']')}, '', 'g')))"


def member(words_sql: str, lexicon) -> str:
    return f"len(list_filter({words_sql}, lambda w: list_contains({sql_list(lexicon)}, w)))"


STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def repair(text: str) -> str:
    spaced = rf"regexp_replace(regexp_replace({text}, '[\t\r]', ' ', 'g'), ' {{2,}}', ' ', 'g')"
    return STRIP.format(spaced)


def unescape(text: str) -> str:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"),
    ):
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    return text


def stage(label: str = "quality") -> str:
    """CTEs ``raw`` and ``cleaned`` of one labelled stage."""
    return f"""
raw AS (SELECT d.doc_id, d.text, l.{label} AS label FROM documents d JOIN labels l USING (doc_id)),
fixed AS (SELECT doc_id, label, {repair('text')} AS text FROM raw WHERE text IS NOT NULL AND label IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM fixed),
cleaned AS (SELECT doc_id, text, label FROM firsts WHERE rn = 1 AND len({words('text')}) >= 10)"""


# Token and sentence base over a relation ``src(doc_id.., text)``.
def base(src: str, keys: str = "doc_id", extra: str = "") -> str:
    return f"""
tok AS (SELECT {keys}{extra}, text, lower(text) AS lt, {words('text')} AS w,
  regexp_split_to_array(text, '[.!?]+') AS p FROM {src}),
sen AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw,
  list_filter(list_transform(p, lambda s: len({words('s')})), lambda n: n > 0) AS sl,
  list_filter(list_transform(p, lambda s: regexp_extract(lower(s), '\\S+')), lambda s: s <> '') AS so FROM tok),
b AS (SELECT *, greatest(len(w), 1) AS nw, greatest(length(text), 1) AS nc, greatest(len(sl), 1) AS ns,
  list_sum(sl)::BIGINT AS s1, list_sum(list_transform(sl, lambda n: n * n))::BIGINT AS s2 FROM sen)"""


VARIANCE = "CASE WHEN len(sl) > 1 THEN (len(sl) * s2 - s1 * s1)::DOUBLE / (len(sl) * len(sl)) ELSE 0.0 END"


def freqs(words_sql: str, keys: str = "doc_id") -> str:
    return f"""
wc AS (SELECT {keys}, word, count(*) AS n FROM (SELECT {keys}, unnest({words_sql}) AS word FROM b) GROUP BY ALL),
fq AS (SELECT {keys}, count(*) AS types, sum(n)::BIGINT AS m1, sum(n * n)::BIGINT AS m2,
  count(*) FILTER (n = 1) AS once, sum(n * log2(n)) AS nlogn FROM wc GROUP BY ALL)"""


CHARS = """
cc AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM b) GROUP BY ALL),
ce AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS char_entropy FROM cc GROUP BY ALL)"""


def syllables(closing: str) -> str:
    """Per-word rule, summed: vowel groups, final e, at least one."""
    bare = f"rtrim(x, {lit(closing)})" if closing else "x"
    groups = f"len(regexp_extract_all({bare}, '[aeiouy]+'))"
    return (
        f"list_sum(list_transform(lw, lambda x: greatest(1, {groups} - "
        f"CASE WHEN {bare} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END)))"
    )


def over(count: str, whole: str) -> str:
    return f"({count})::DOUBLE / {whole}"


PROF = {
    "char_len": "nc::DOUBLE",
    "word_count": "nw::DOUBLE",
    "sent_count": "ns::DOUBLE",
    "avg_word_len": over("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "nw"),
    "unique_ratio": over("coalesce(fq.types, 0)", "nw"),
    "hapax_ratio": "coalesce(fq.once::DOUBLE / fq.types, 0.0)",
    "stop_ratio": over(member("lw", lx.PROFILE_STOP_WORDS), "nw"),
    "punct_density": over(count_class("text", r".,;:!?()\[\]{}\"'\-"), "nc"),
    "question_density": over(count_class("text", "?"), "ns"),
    "exclaim_density": over(count_class("text", "!"), "ns"),
    "comma_density": over(count_class("text", ","), "nc"),
    "cap_ratio": f"coalesce({count_class('text', r'\p{Lu}')}::DOUBLE / nullif({count_class('text', r'\pL')}, 0), 0.0)",
    "allcaps_ratio": over("len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))", "nw"),
    "digit_ratio": over(count_class("text", r"\p{Nd}"), "nc"),
    "special_ratio": over(count_class("text", r"^\pL\pN\s"), "nc"),
    "avg_sent_len": "coalesce(s1::DOUBLE / nullif(len(sl), 0), 0.0)",
    "sent_len_std": f"sqrt({VARIANCE})",
    "sent_len_var": VARIANCE,
    "char_entropy": "coalesce(ce.char_entropy, 0.0)",
    "word_entropy": "coalesce(log2(fq.m1) - fq.nlogn / fq.m1, 0.0)",
    "you_ratio": over(member("lw", lx.SECOND_PERSON), "nw"),
    "modal_ratio": over(member("lw", lx.MODAL_VERBS), "nw"),
    "imp_ratio": over(member("so", lx.PROFILE_IMPERATIVES), "ns"),
    "quote_density": over(count_class("text", "\"'"), "nc"),
    "readability": "CASE WHEN len(w) > 0 AND len(sl) > 0 THEN greatest(0.0, least(100.0, "
    f"206.835 - 1.015 * (nw::DOUBLE / ns) - 84.6 * ({syllables('.,;:!?')}::DOUBLE / nw))) ELSE 0.0 END",
}


def prof_rows(src: str, keys: str = "doc_id", extra: str = "") -> str:
    """CTEs ending in ``prof``: every profile feature of ``src``."""
    columns = ", ".join(f"{e} AS {n}" for n, e in PROF.items())
    return f"""{base(src, keys, extra)},{freqs('lw', keys)},{CHARS},
prof AS (SELECT b.doc_id{extra}, {columns} FROM b LEFT JOIN fq USING (doc_id) LEFT JOIN ce USING (doc_id))"""


def prof_query(*features: str, rounded: tuple[str, ...] = ()) -> str:
    columns = ", ".join(f"round({f}, 6) AS {f}" if f in rounded else f for f in features)
    return f"WITH {prof_rows('documents')} SELECT doc_id, {columns} FROM prof"


def rounded_tested() -> str:
    columns = ", ".join(
        f"round({f}, 9) AS {f}" if "entropy" in f or f == "readability" else f
        for f in profile.TESTED_FEATURES
    )
    return f"tested AS (SELECT label, {columns} FROM prof)"


def staged_profile() -> str:
    return f"{stage()},{prof_rows('cleaned', extra=', label')},{rounded_tested()}"


def long_table(src: str, features, name: str = "lng") -> str:
    return f"{name} AS (UNPIVOT (SELECT label, {', '.join(features)} FROM {src}) ON {', '.join(features)} INTO NAME feature VALUE value)"


def moment_columns(prefix: str = "") -> str:
    return "avg(value) AS mean, stddev_pop(value) AS std"


RANKS = """
rk AS (SELECT feature, label, rank() OVER w + (count(*) OVER t - 1) / 2.0 AS r, count(*) OVER t AS t
  FROM lng WINDOW w AS (PARTITION BY feature ORDER BY value), t AS (PARTITION BY feature, value)),
uz AS (SELECT feature, count(*) FILTER (label = 0) AS n_0, count(*) FILTER (label = 1) AS n_1,
  sum(r) FILTER (label = 0) AS r0, sum((t * t - 1)::DOUBLE) AS ties FROM rk GROUP BY feature),
u AS (SELECT feature, n_0, n_1, r0 - n_0 * (n_0 + 1) / 2.0 AS u_statistic, ties,
  n_0 * n_1 / 2.0 AS mu, n_0 + n_1 AS n FROM uz),
tests AS (SELECT feature, n_0, n_1, u_statistic::DOUBLE AS u_statistic,
  coalesce(greatest(abs(u_statistic - mu) - 0.5, 0) /
    nullif(sqrt(n_0 * n_1 / 12.0 * greatest(n + 1 - ties / (n * (n - 1.0)), 0)), 0), 0.0) AS z FROM u)"""


def histogram_sql() -> str:
    features = ["char_len", "word_count", "sent_count"]
    return f"""WITH {staged_profile()}, {long_table('tested', features)},
lim AS (SELECT feature, quantile_cont(value, 0.99) AS lim FROM lng GROUP BY feature),
c AS (SELECT feature, label, least(greatest(value, 0.0), lim) AS v FROM lng JOIN lim USING (feature)),
rg AS (SELECT feature, label, min(v) AS lo, max(v) AS hi, count(*) AS total FROM c GROUP BY ALL),
e AS (SELECT feature, label, total, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
  CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM rg),
pl AS (SELECT feature, label, total, (hi - lo) / 50 AS width,
  least(floor((v - lo) * 50 / (hi - lo)), 49)::INTEGER AS bin FROM c JOIN e USING (feature, label))
SELECT feature, label, bin, count(*) AS n, round(count(*) / (any_value(total) * any_value(width)), 6) AS density
FROM pl GROUP BY feature, label, bin"""


def box_sql() -> str:
    features = ["char_len", "word_count", "sent_count"]
    return f"""WITH {staged_profile()}, {long_table('tested', features)},
lim AS (SELECT feature, quantile_cont(value, 0.99) AS lim FROM lng GROUP BY feature),
c AS (SELECT feature, label, least(greatest(value, 0.0), lim) AS v FROM lng JOIN lim USING (feature)),
q AS (SELECT feature, label, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM c GROUP BY ALL),
m AS (SELECT c.*, q1, median, q3, v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM c JOIN q USING (feature, label))
SELECT feature, label, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3, round(min(v) FILTER (inside), 6) AS whisker_lo,
  round(max(v) FILTER (inside), 6) AS whisker_hi, count(*) FILTER (NOT inside) AS n_outliers
FROM m GROUP BY feature, label"""


def moments_sql() -> str:
    return f"""WITH {stage()},{prof_rows('cleaned', extra=', label')}, {long_table('prof', profile.PROFILE_FEATURES)}
SELECT feature, label, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM lng GROUP BY feature, label"""


def corr_sql() -> str:
    features = profile.CORRELATED_FEATURES
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    selects = " UNION ALL ".join(
        f"SELECT {lit(a)} AS feature_a, {lit(b)} AS feature_b, r{i} AS r FROM c" for i, (a, b) in enumerate(pairs)
    )
    columns = ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(pairs))
    return f"""WITH {staged_profile()}, c AS MATERIALIZED (SELECT {columns} FROM tested)
SELECT feature_a, feature_b, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 5) AS r FROM ({selects})"""


def keyword_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT role, {lit(k)} AS keyword, count(*) FILTER (contains(lower(text), {lit(k.lower())})) AS n_texts, "
        "count(*) AS n FROM src GROUP BY role"
        for k in lx.UNSAFE_KEYWORDS
    )
    return f"""WITH src AS (SELECT role, text FROM conversations UNION ALL
SELECT 'toxic=' || l.toxic, d.text FROM documents d JOIN labels l USING (doc_id))
SELECT role, keyword, n_texts, n_texts / n AS share FROM ({rows})"""


BLOCK_B = {
    "sty_avg_word_len": over("coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)", "nw"),
    "sty_avg_sent_len": "nw::DOUBLE / ns",
    "sty_sent_std": f"sqrt({VARIANCE})",
    "sty_unique_ratio": "fq.types::DOUBLE / nw",
    "sty_hapax": "fq.once::DOUBLE / nw",
    "sty_stop_ratio": over(member("lw", lx.ENGLISH_STOP_WORDS), "nw"),
    "sty_punct_density": over(count_class("text", r"!-/:-@\[-`{-~"), "nc"),
    "sty_capital_ratio": over(count_class("text", r"\p{Lu}"), "nc"),
    "sty_digit_ratio": over(count_class("text", r"\p{Nd}"), "nc"),
    "sty_special_ratio": over(count_class("text", r"^\pL\pN\s"), "nc"),
}
BLOCK_C = {
    "stat_char_entropy": "round(ce.char_entropy, 6)",
    "stat_word_entropy": "round(log2(fq.m1) - fq.nlogn / fq.m1, 6)",
    "stat_token_div": "fq.types::DOUBLE / nw",
    "stat_repetition": "(fq.types - fq.once)::DOUBLE / fq.types",
    "stat_burstiness": "(fq.types * fq.m2 - fq.m1 * fq.m1)::DOUBLE / (fq.types * fq.m1)",
    "stat_yule_k": "CASE WHEN fq.m1 > 1 THEN (10000 * (fq.m2 - fq.m1))::DOUBLE / (fq.m1 * fq.m1) ELSE 0.0 END",
    "stat_simpson": "round(1.0 - fq.m2::DOUBLE / (fq.m1 * fq.m1), 6)",
}
BLOCK_D = {
    "ling_ent_density": over(r"len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}')))", "nw"),
    "ling_readability": "round(greatest(0.0, least(100.0, 206.835 - 1.015 * (nw::DOUBLE / ns) - 84.6 * "
    f"({syllables('')}::DOUBLE / nw))) / 100.0, 6)",
}
BLOCK_F = {
    "str_q_density": over(count_class("text", "?"), "nc"),
    "str_exc_density": over(count_class("text", "!"), "nc"),
    "str_imp_ratio": over(member("so", lx.STRUCTURAL_IMPERATIVES), "ns"),
    "str_you_ratio": over("len(regexp_extract_all(lt, 'you'))", "nw"),
    "str_modal_ratio": over("len(regexp_extract_all(lt, 'can'))", "nw"),
    "str_quote_density": over(count_class("text", '"'), "nc"),
    "str_allcaps_ratio": over("len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x))", "nw"),
    "str_sent_var": VARIANCE,
}


def block_sql(columns: dict[str, str]) -> str:
    cols = ", ".join(f"CASE WHEN len(w) > 0 THEN {e} ELSE 0.0 END AS {n}" for n, e in columns.items())
    return f"""WITH {base('documents')},{freqs('w')},{CHARS}
SELECT b.doc_id, {cols} FROM b LEFT JOIN fq USING (doc_id) LEFT JOIN ce USING (doc_id)"""


HASHED = f"""
t AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 384)::INTEGER AS bucket, count(*) AS tf
  FROM (SELECT doc_id, unnest({words('lower(text)')}) AS word FROM documents) GROUP BY ALL),
df AS (SELECT bucket, count(*) AS df FROM t GROUP BY bucket),
wt AS (SELECT doc_id, bucket, tf * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1) AS v
  FROM t JOIN df USING (bucket)),
nm AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM wt GROUP BY doc_id)"""


def bigram_rows(src: str, keys: str, name: str) -> str:
    """CTE of (keys, w1, w2) with a start mark before the first word."""
    return f"""
{name}_w AS (SELECT {keys}, {words('lower(text)')} AS w FROM {src}),
{name} AS (SELECT {keys}, CASE WHEN nr = 1 THEN '<s>' ELSE w[nr - 1] END AS w1, w[nr] AS w2
  FROM (SELECT {keys}, w, unnest(range(1, len(w) + 1)) AS nr FROM {name}_w))"""


BIGRAM_MODEL = f"""{bigram_rows('documents', 'doc_id', 'bg')},
c12 AS (SELECT w1, w2, count(*) AS c12 FROM bg GROUP BY ALL),
ctx AS (SELECT w1, sum(c12)::BIGINT AS c1, count(*) AS t1 FROM c12 GROUP BY ALL),
uni AS (SELECT w2, sum(c12)::BIGINT AS n2 FROM c12 GROUP BY ALL),
voc AS (SELECT sum(n2)::DOUBLE + count(*) + 1 AS d FROM uni)"""

# Witten-Bell weights between pair counts and word frequencies.
UNIGRAM = "((coalesce(n2, 0) + 1) / d)"
BIGRAM_NLL = f"-sum(ln(CASE WHEN c1 IS NULL THEN {UNIGRAM} ELSE (coalesce(c12, 0) + t1 * {UNIGRAM}) / (c1 + t1) END)) / count(*)"
BIGRAM_JOINS = "LEFT JOIN c12 USING (w1, w2) LEFT JOIN ctx USING (w1) LEFT JOIN uni USING (w2), voc"


def oracle() -> dict[str, str]:
    f = profile
    queries = {
        "class_overview": f"""WITH {stage()},
z AS (SELECT label, greatest(length(text), 1) AS c, greatest(len({words('text')}), 1) AS w,
  greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))), 1) AS s FROM cleaned)
SELECT label, count(*) AS n_texts, sum(c)::DOUBLE / count(*) AS avg_chars, sum(w)::DOUBLE / count(*) AS avg_words,
  sum(s)::DOUBLE / count(*) AS avg_sents, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct_of_total
FROM z GROUP BY label""",
        "clean_docs": f"WITH {stage()} SELECT doc_id, label, md5(text) AS text_md5 FROM cleaned",
        "exact_dedup": "SELECT min(doc_id) AS doc_id, length(text) AS n_chars FROM documents GROUP BY text",
        "min_words": f"SELECT doc_id, len({words('text')}) AS n_words FROM documents WHERE len({words('text')}) >= 10",
        "cleaning_funnel": f"""WITH {stage()},
c AS (SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM fixed) AS valid,
  (SELECT count(*) FROM firsts WHERE rn = 1) AS uniq, (SELECT count(*) FROM cleaned) AS kept),
s AS (SELECT 1 AS step_no, 'drop_nulls' AS step, raw AS rows_before, valid AS rows_after FROM c
  UNION ALL SELECT 2, 'exact_dedup', valid, uniq FROM c UNION ALL SELECT 3, 'min_words', uniq, kept FROM c
  UNION ALL SELECT 4, 'total', raw, kept FROM c)
SELECT *, rows_before - rows_after AS removed,
  coalesce((rows_before - rows_after) * 100.0::DOUBLE / nullif(rows_before, 0), 0.0) AS removed_pct FROM s""",
        "class_balance": f"""WITH {stage()},
c AS (SELECT 'raw' AS phase, label, count(*) AS n FROM raw GROUP BY ALL
  UNION ALL SELECT 'clean', label, count(*) FROM cleaned GROUP BY ALL)
SELECT label, n, max(n) OVER (PARTITION BY phase) / min(n) OVER (PARTITION BY phase) AS imbalance, phase FROM c""",
        "word_count_stats": f"""WITH {stage()}, z AS (SELECT len({words('text')}) AS w FROM cleaned)
SELECT count(*) AS n_texts, sum(w)::DOUBLE / count(*) AS mean_words, quantile_cont(w, 0.5)::DOUBLE AS median_words,
  sqrt((count(*) * sum(w * w) - sum(w) * sum(w))::DOUBLE / (count(*) * (count(*) - 1))) AS std_words,
  min(w)::INTEGER AS min_words, max(w)::INTEGER AS max_words FROM z""",
        "contamination": """WITH a AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT md5(text) AS h FROM benchmark WHERE text IS NOT NULL)
SELECT (SELECT count(*) FROM a) AS unique_a, (SELECT count(*) FROM b) AS unique_b,
  (SELECT count(*) FROM a JOIN b USING (h)) AS overlap""",
        "contaminated_rows": """SELECT doc_id FROM documents
WHERE text IN (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)""",
        "contaminated_sources": """SELECT doc_id FROM documents WHERE source = 'src0'
  AND text IN (SELECT text FROM documents WHERE source <> 'src0')""",
        "clean_langs": f"""WITH fixed AS (SELECT doc_id, lang AS label, {repair('text')} AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM fixed),
kept AS (SELECT doc_id, text, label FROM firsts WHERE rn = 1 AND len({words('text')}) >= 10),
m AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS id FROM (SELECT DISTINCT label FROM kept))
SELECT doc_id, id AS label, md5(text) AS text_md5 FROM kept JOIN m USING (label)""",
        "label_encode": """WITH m AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS id
  FROM (SELECT DISTINCT lang AS label FROM documents))
SELECT doc_id, id AS label FROM documents JOIN m ON m.label = documents.lang""",
        "normalize_text": f"""SELECT page_id, md5({STRIP.format(
            "regexp_replace(regexp_replace(nfc_normalize(html), '[^\\S\\n]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
        )}) AS text_md5 FROM pages""",
        "html_clean": f"SELECT page_id, md5({repair(unescape('html'))}) AS text_md5 FROM pages",
        "input_guard": f"""SELECT role, CASE WHEN text IS NULL OR len({words('text')}) = 0 THEN 'empty'
  WHEN len({words('text')}) < 5 THEN 'too short' ELSE 'accepted' END AS reason, count(*) AS n
FROM conversations GROUP BY ALL""",
        "before_after_hist": f"""WITH {stage()},
z AS (SELECT 'before' AS phase, len({words('text')}) AS w FROM raw WHERE text IS NOT NULL
  UNION ALL SELECT 'after', len({words('text')}) FROM cleaned),
c AS (SELECT phase, least(w, 1000) AS c FROM z),
g AS (SELECT phase, quantile_cont(w, 0.5)::DOUBLE AS median_words FROM z GROUP BY phase),
r AS (SELECT phase, min(c) AS lo, max(c) AS hi FROM c GROUP BY phase)
SELECT phase, least(coalesce(floor((c - lo) * 60 / nullif(hi - lo, 0)), 0), 59)::INTEGER AS bin, count(*) AS n,
  any_value(median_words) AS median_words FROM c JOIN r USING (phase) JOIN g USING (phase) GROUP BY ALL""",
        "prof_length": prof_query("char_len", "word_count", "sent_count", "avg_word_len"),
        "prof_lexical": prof_query("unique_ratio", "hapax_ratio", "stop_ratio"),
        "prof_chars": prof_query(
            "punct_density", "question_density", "exclaim_density", "comma_density",
            "cap_ratio", "allcaps_ratio", "digit_ratio", "special_ratio", "quote_density",
        ),
        "prof_sentence": prof_query("avg_sent_len", "sent_len_std", "sent_len_var"),
        "prof_intent": prof_query("you_ratio", "modal_ratio", "imp_ratio"),
        "prof_readability": prof_query("readability", rounded=("readability",)),
        "prof_entropy": prof_query("char_entropy", "word_entropy", rounded=("char_entropy", "word_entropy")),
        "prof_prompts": f"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
{base('u', 'conv_id, turn')} SELECT conv_id, turn, nw::DOUBLE AS word_count,
  {', '.join(f'{PROF[c]} AS {c}' for c in ('you_ratio', 'modal_ratio', 'imp_ratio'))} FROM b""",
        "word_counts": f"""WITH wc AS (SELECT doc_id, word, count(*) AS n FROM
  (SELECT doc_id, unnest({words('lower(text)')}) AS word FROM documents) GROUP BY ALL)
SELECT n, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM wc GROUP BY n""",
        "text_stats": f"""WITH {base('documents')} SELECT doc_id, length(text) AS n_chars, len(w) AS n_words,
  len(sl) AS n_sents, len(list_distinct(lw)) AS n_unique,
  {PROF['avg_word_len']} AS avg_word_len, len(w)::DOUBLE / ns AS avg_sent_len FROM b""",
        "feature_moments": moments_sql(),
        "mann_whitney_u": f"""WITH {staged_profile()}, {long_table('tested', f.TESTED_FEATURES)},{RANKS}
SELECT feature, n_0, n_1, u_statistic, round(z, 6) AS z FROM tests""",
        "percentile_clip": f"""WITH {staged_profile()}, {long_table('tested', f.TESTED_FEATURES)}
SELECT feature, 0.5::DOUBLE AS fraction, round(quantile_cont(value, 0.5), 6) AS value FROM lng GROUP BY feature
UNION ALL SELECT feature, 0.99::DOUBLE, round(quantile_cont(value, 0.99), 6) FROM lng GROUP BY feature""",
        "class_histogram": histogram_sql(),
        "box_stats": box_sql(),
        "top_words": f"""WITH {stage()},
wd AS (SELECT label, unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+')) AS word FROM cleaned),
ct AS (SELECT label, word, count(*) AS n FROM wd WHERE regexp_full_match(word, '[a-z]{{3,}}') AND NOT list_contains({sql_list(lx.PROFILE_STOP_WORDS)}, word) GROUP BY ALL),
rk AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY n DESC, word)::INTEGER AS rank, word, n FROM ct)
SELECT * FROM rk WHERE rank <= 30""",
        "keyword_share": keyword_sql(),
        "feature_corr": corr_sql(),
        "vector_summary": """SELECT vec_id, len(embedding) AS dims, list_min(embedding)::DOUBLE AS min_value,
  list_max(embedding)::DOUBLE AS max_value,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS mean_value FROM embeddings""",
        "block_b": block_sql(BLOCK_B),
        "block_c": block_sql(BLOCK_C),
        "block_d": block_sql(BLOCK_D),
        "block_f": block_sql(BLOCK_F),
        "block_a_hashed": f"""WITH {HASHED} SELECT doc_id, bucket, round(v / norm, 6) AS weight
FROM wt JOIN nm USING (doc_id) WHERE v / norm > 0""",
        "bigram_ppl": f"""WITH {BIGRAM_MODEL},
p AS (SELECT doc_id, exp({BIGRAM_NLL}) AS ppl FROM bg {BIGRAM_JOINS} GROUP BY doc_id)
SELECT doc_id, round(coalesce(ppl, 500.0), 4) AS ppl FROM documents LEFT JOIN p USING (doc_id)""",
        "bigram_ppl_prompts": f"""WITH {BIGRAM_MODEL},{bigram_rows('conversations', 'conv_id, turn', 'q')}
SELECT conv_id, turn, round(exp({BIGRAM_NLL}), 4) AS ppl FROM q {BIGRAM_JOINS} GROUP BY conv_id, turn""",
    }
    return queries
