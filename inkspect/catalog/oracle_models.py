"""SQL for the style, scoring and model-selection queries."""

from __future__ import annotations

from inkspect.catalog.oracle import BIGRAM_JOINS, BIGRAM_MODEL, BIGRAM_NLL, UNIGRAM, base, bigram_rows, lit, member, over, sql_list, words
from inkspect.functions import lexicons as lx

SEEDS = (42, 123, 456, 789, 2024)


def hits(phrases) -> str:
    return f"len(list_filter({sql_list(phrases)}, lambda p: contains(lt, p)))"


def occurrences(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, {lit(needle)}, ''))) // {len(needle)})"


STARTS = " OR ".join(f"starts_with(ltrim(lower(s), chr(10) || ' '), {lit(o)})" for o in lx.STARTERS)
RUNS = (
    "len(list_filter(range(3, len(ch) + 1), lambda i: ch[i] = ch[i - 1] AND ch[i] = ch[i - 2] "
    "AND (i = 3 OR ch[i - 3] <> ch[i]) AND ch[i] <> chr(10)))"
)
SIGNALS = {
    "transitions": f"least({over(hits(lx.TRANSITIONS), 'ns')}, 1.0)",
    "hedging": f"least({over(member('lw', lx.HEDGING), 'nw')} * 20, 1.0)",
    "human_markers": f"least({over(member('lw', lx.HUMAN_MARKERS), 'nw')} * 50, 1.0)",
    "uniformity": "CASE WHEN len(sl) > 1 THEN greatest(0.0, 1.0 - sqrt((len(sl) * s2 - s1 * s1)::DOUBLE / (len(sl) * len(sl)))"
    " / greatest(s1::DOUBLE / len(sl), 1.0)) ELSE 0.5 END",
    "formal_punct": "1.0 - least((contains(text, '...')::INT + (" + occurrences("text", "!") + " > 2)::INT + ("
    + occurrences("text", "?") + " > 2)::INT + contains(text, '--')::INT) / 3.0, 1.0)",
    "first_person": f"greatest(0.0, 1.0 - {over(member('lw', lx.FIRST_PERSON), 'nw')} * 30)",
    "paragraph": "CASE WHEN len(pl) > 1 THEN least(list_sum(pl)::DOUBLE / len(pl) / 80, 1.0) ELSE 0.5 END",
    "phrase_match": f"least({over(hits(lx.AI_PHRASES), 'ns')}, 1.0)",
    "starter_match": f"least({over(f'len(list_filter(p, lambda s: {STARTS}))', 'ns')}, 1.0)",
    "comma_density": f"least({over(occurrences('text', ','), 'nw')} / 0.12::DOUBLE, 1.0)",
    "repetitive": "CASE WHEN len(sl) >= 3 THEN greatest(0.0, 1.0 - len(list_distinct(so))::DOUBLE / len(so)) ELSE 0.5 END",
    "no_contractions": "greatest(0.0, 1.0 - "
    + over(" + ".join(occurrences("lt", c) for c in lx.CONTRACTIONS), "ns")
    + " / 2)",
    "has_typos": f"least({over(RUNS, 'ns')}, 1.0)",
}
EXACT = [s for s in SIGNALS if s != "has_typos"]


def style_rows(src: str, keys: str = "doc_id") -> str:
    columns = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in SIGNALS.items())
    return f"""{base(src, keys)},
b2 AS (SELECT *, string_split(text, '') AS ch,
  list_filter(list_transform(string_split(text, chr(10)), lambda p: len({words('p')})), lambda n: n > 0) AS pl FROM b),
st0 AS (SELECT {keys}, nw::BIGINT AS n_words, {columns}, {hits(lx.META_PHRASES)}::INTEGER AS meta_hits FROM b2),
st AS (SELECT *, greatest(0.0, 0.12 * transitions + 0.12 * hedging + 0.10 * phrase_match + 0.10 * starter_match
  + 0.08 * uniformity + 0.08 * formal_punct + 0.08 * first_person + 0.08 * comma_density + 0.06 * repetitive
  + 0.06 * no_contractions + 0.06 * paragraph + 0.03 * (1 - human_markers) + 0.03 * (1 - has_typos)
  - 0.3 * human_markers) AS ai_style FROM st0)"""


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


WINDOWS = f"""
w0 AS (SELECT doc_id, {words('text')} AS w FROM documents),
w1 AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 512) / 256.0), 0)::BIGINT + 1)) AS pos FROM w0 WHERE len(w) > 0),
win AS (SELECT doc_id, pos::INTEGER AS pos, w[pos * 256 + 1 : pos * 256 + 512] AS c FROM w1),
wt AS (SELECT doc_id, pos, len(c)::INTEGER AS n_tokens, array_to_string(c, ' ') AS text FROM win)"""


def draw(text: str, first: int = 1, width: int = 8) -> str:
    return f"(('0x' || substr(md5({text}), {first}, {width}))::UBIGINT / {float(16 ** width)})"


def sentence_rows(least_words: int) -> str:
    """CTE ``se``: sentences cut after . ! ? and white space."""
    return f"""
s0 AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM documents),
se AS (SELECT doc_id, i, regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '') AS text FROM s0
  WHERE len({words('s')}) >= {least_words})"""


DECIDED = f"""WITH {style_rows('documents')},
e0 AS (SELECT doc_id, n_words, meta_hits, {rounded([*EXACT, 'has_typos', 'ai_style'])},
  ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::UBIGINT / 65536.0 AS x0,
  ('0x' || substr(md5(doc_id::VARCHAR), 5, 4))::UBIGINT / 65536.0 AS o0,
  ('0x' || substr(md5(doc_id::VARCHAR), 9, 4))::UBIGINT / 65536.0 AS f0 FROM st),
e1 AS (SELECT *, CASE WHEN x0 < 0.5 THEN x0 * x0 ELSE x0 END AS x, CASE WHEN o0 < 0.5 THEN o0 * o0 ELSE o0 END AS o,
  CASE WHEN f0 < 0.5 THEN f0 * f0 ELSE f0 END AS f, ai_style + least(0.15 * meta_hits, 0.30) AS eff,
  (first_person < 0.3)::INT + (no_contractions < 0.7)::INT + (human_markers > 0.01)::INT + (has_typos > 0.05)::INT AS ev FROM e0),
e2 AS (SELECT *, CASE
  WHEN x < 0.3 AND o < 0.3 AND f > 0.7 AND meta_hits >= 2 THEN 'chatgpt-detected'
  WHEN x < 0.3 AND o < 0.3 AND f > 0.7 AND eff > 0.4 THEN 'style-confirms-ai'
  WHEN x < 0.3 AND o < 0.3 AND f > 0.7 AND eff > 0.25 AND ev >= 2 THEN 'ambiguous-human-evidence'
  WHEN x < 0.3 AND o < 0.3 AND f > 0.7 AND eff > 0.25 THEN 'style-ambiguous'
  WHEN x < 0.3 AND o < 0.3 AND f > 0.7 THEN 'override-human'
  WHEN least(x, o, f) > 0.55 THEN 'unanimous-ai'
  WHEN greatest(x, o, f) < 0.45 THEN 'unanimous-human'
  WHEN x < 0.1 AND (eff < 0.4 OR first_person < 0.15) THEN
    'xgb-human-' || CASE ev + (o < 0.55)::INT WHEN 0 THEN 'weak' WHEN 1 THEN 'moderate' WHEN 2 THEN 'moderate' ELSE 'strong' END
  ELSE 'weighted' END AS mode FROM e1),
wts(mode, wx, wo, wf) AS (VALUES ('chatgpt-detected', 0.10, 0.10, 0.80), ('style-confirms-ai', 0.15, 0.15, 0.70),
  ('ambiguous-human-evidence', 0.30, 0.30, 0.40), ('style-ambiguous', 0.25, 0.25, 0.50), ('override-human', 0.35, 0.35, 0.30),
  ('unanimous-ai', 0.20, 0.25, 0.55), ('unanimous-human', 0.30, 0.30, 0.40), ('xgb-human-strong', 0.55, 0.20, 0.25),
  ('xgb-human-moderate', 0.50, 0.20, 0.30), ('xgb-human-weak', 0.30, 0.25, 0.45), ('weighted', 0.25, 0.30, 0.45)),
e3 AS (SELECT e2.*, CASE WHEN mode = 'weighted' AND n_words < 30 THEN 0.1 * x + 0.4 * o + 0.5 * f
  WHEN mode = 'xgb-human-strong' THEN wx * x + wo * CASE WHEN o > 0.35 AND o < 0.65 THEN least(o, 0.4) ELSE o END + wf * least(f, 0.3)
  WHEN mode = 'xgb-human-moderate' THEN wx * x + wo * CASE WHEN o > 0.35 AND o < 0.65 THEN least(o, 0.4) ELSE o END + wf * least(f, 0.4)
  ELSE wx * x + wo * o + wf * f END AS blend FROM e2 JOIN wts USING (mode)),
e4 AS (SELECT *, greatest(-0.2, least(0.2,
  CASE WHEN ai_style > 0.5 THEN 0.06 WHEN ai_style > 0.4 THEN 0.03 WHEN ai_style < 0.2 THEN -0.06
    WHEN ai_style < 0.3 THEN -0.03 WHEN ai_style < 0.38 THEN -0.02 ELSE 0 END
  + CASE WHEN x < 0.05 AND ai_style < 0.38 THEN -0.08 WHEN x < 0.1 AND ai_style < 0.33 THEN -0.04 ELSE 0 END
  + CASE WHEN phrase_match > 0.3 THEN 0.04 ELSE 0 END + CASE WHEN starter_match > 0.3 THEN 0.03 ELSE 0 END
  + CASE WHEN human_markers > 0.05 THEN -0.12 WHEN human_markers > 0.01 THEN -0.05 ELSE 0 END
  + CASE WHEN no_contractions < 0.5 THEN -0.05 ELSE 0 END
  + CASE WHEN first_person < 0.2 THEN -0.06 WHEN first_person < 0.4 THEN -0.03 ELSE 0 END
  + CASE WHEN has_typos > 0.1 THEN -0.06 ELSE 0 END
  + CASE WHEN least(x, o, f) > 0.75 THEN 0.06 WHEN greatest(x, o, f) < 0.25 THEN -0.06 ELSE 0 END
  + CASE WHEN (x < 0.4)::INT + (o < 0.4)::INT + (f < 0.4)::INT >= 2 AND blend > 0.5 THEN -0.08
    WHEN (x > 0.6)::INT + (o > 0.6)::INT + (f > 0.6)::INT >= 2 AND blend < 0.5 THEN 0.08 ELSE 0 END))::DOUBLE AS shift FROM e3),
e5 AS (SELECT *, greatest(0.0, least(1.0, blend + shift)) AS raw,
  sqrt(greatest(0.0, (x * x + o * o + f * f) / 3.0 - ((x + o + f) / 3.0) * ((x + o + f) / 3.0))) AS model_std FROM e4),
e6 AS (SELECT *, CASE WHEN raw > 0.35 AND raw < 0.65 THEN 0.5 + 1.3 * (raw - 0.5) ELSE raw END AS p_ai FROM e5),
dec AS (SELECT *, CASE WHEN p_ai >= 0.5 THEN 'ai' ELSE 'human' END AS verdict, greatest(p_ai, 1 - p_ai) AS confidence,
  CASE WHEN least(x, o, f) > 0.75 OR greatest(x, o, f) < 0.25 THEN 'High'
    WHEN least(x, o, f) > 0.55 OR greatest(x, o, f) < 0.45 THEN 'Good'
    WHEN x < 0.3 AND o < 0.3 AND f > 0.7 THEN mode WHEN model_std > 0.35 THEN 'Low' ELSE 'Moderate' END AS agreement FROM e6)"""


def ranked(label: str, seed: int) -> str:
    return (
        f"SELECT doc_id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY "
        f"md5('{seed}-' || doc_id), doc_id) - 1 AS r, count(*) OVER (PARTITION BY {label}) AS n FROM labels"
    )


KFOLD = f"SELECT doc_id, label, (r % 5)::INTEGER AS fold FROM ({ranked('quality', 42)})"

VEC = "ve AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 0)::INTEGER AS label FROM embeddings)"
NEAR = f"""{VEC},
pr AS (SELECT a.vec_id, b.vec_id AS nn_id, b.label, pow(list_distance(a.v, b.v), 2) AS d2
  FROM ve a JOIN ve b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, nn_id)::INTEGER AS rank FROM pr QUALIFY rank <= 5)"""
SMOTE = f"""{VEC},
mn AS (SELECT *, row_number() OVER (ORDER BY md5('42-' || vec_id), vec_id) - 1 AS r FROM ve WHERE label = 1),
sz AS (SELECT count(*) FILTER (label = 0) - count(*) FILTER (label = 1) AS deficit, count(*) FILTER (label = 1) AS n FROM ve),
pr AS (SELECT a.vec_id, b.vec_id AS nn_id, list_distance(a.v, b.v) AS dist FROM mn a JOIN mn b ON a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nn_id) AS rank FROM pr QUALIFY rank <= 5),
dr AS (SELECT vec_id, v, unnest(range(1, deficit // n + CASE WHEN r < deficit % n THEN 1 ELSE 0 END + 1)) AS draw FROM mn, sz),
dk AS (SELECT *, ('0x' || substr(md5('42-' || vec_id || '-' || draw), 1, 8))::UBIGINT % 5 + 1 AS pick,
  ('0x' || substr(md5('42-' || vec_id || '-' || draw), 9, 8))::UBIGINT / 4294967296.0 AS u FROM dr)"""
NB = f"""{VEC},
ex AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM ve),
pv AS (SELECT 1e-9 * max(s) AS smooth FROM (SELECT var_pop(x) AS s FROM ex GROUP BY dim)),
cm AS (SELECT label AS c, dim, avg(x) AS m, var_pop(x) + (SELECT smooth FROM pv) AS s FROM ex GROUP BY ALL),
prior AS (SELECT label AS c, ln(count(*)::DOUBLE / (SELECT count(*) FROM ve)) AS lp FROM ve GROUP BY label),
ll AS (SELECT vec_id, label, c, any_value(lp) - 0.5 * sum(ln(2 * pi() * s) + (x - m) * (x - m) / s) AS ll
  FROM ex JOIN cm USING (dim) JOIN prior USING (c) GROUP BY vec_id, label, c),
nb AS (SELECT vec_id, label, arg_max(c, ll)::INTEGER AS prediction, max(ll) - min(ll) AS margin FROM ll GROUP BY vec_id, label)"""


# Sigmoid over signed margins: damped Newton steps, counted through to the end.
PLATT = f"""{NB},
mg AS (SELECT label, CASE WHEN prediction = 1 THEN margin ELSE -margin END AS m FROM nb),
ct AS (SELECT count(*) FILTER (label = 0)::DOUBLE AS n0, count(*) FILTER (label = 1)::DOUBLE AS n1 FROM mg),
tg AS (SELECT label, m, CASE WHEN label = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM mg, ct),
st(i, a, b) AS (SELECT 0, 0.0::DOUBLE, ln((n0 + 1) / (n1 + 1)) FROM ct UNION ALL
  SELECT i + 1, a - 0.5 * (bb * ga - ab * gb) / (aa * bb - ab * ab), b - 0.5 * (aa * gb - ab * ga) / (aa * bb - ab * ab) FROM (
    SELECT i, a, b, sum(m * (t - p)) AS ga, sum(t - p) AS gb, sum(m * m * p * (1 - p)) AS aa, sum(m * p * (1 - p)) AS ab, sum(p * (1 - p)) AS bb
    FROM (SELECT i, a, b, m, t, 1 / (1 + exp(a * m + b)) AS p FROM st, tg WHERE i < 80) GROUP BY i, a, b))"""

# Bigram models of every split, each counted anew without the folds (a, b).
FOLDED = f"""fo AS ({{kfold}}),
{bigram_rows('documents', 'doc_id', 'bg')},
bf AS (SELECT bg.*, coalesce(fold, -1) AS a FROM bg LEFT JOIN fo USING (doc_id)),
ky AS (SELECT a, a AS b FROM range(-1, 5) AS t(a) UNION SELECT a, 0 FROM range(-1, 5) AS t(a)),
mc AS (SELECT ky.a, ky.b, w1, w2, count(*) AS c12 FROM bf JOIN ky ON bf.a >= 0 AND bf.a <> ky.a AND bf.a <> ky.b GROUP BY ALL),
cx AS (SELECT a, b, w1, sum(c12)::BIGINT AS c1, count(*) AS t1 FROM mc GROUP BY ALL),
un AS (SELECT a, b, w2, sum(c12)::BIGINT AS n2 FROM mc GROUP BY ALL),
vo AS (SELECT a, b, sum(n2)::DOUBLE + count(*) + 1 AS d FROM un GROUP BY ALL),
pp AS (SELECT doc_id, b, exp({BIGRAM_NLL}) AS ppl FROM bf JOIN ky USING (a) LEFT JOIN mc USING (a, b, w1, w2)
  LEFT JOIN cx USING (a, b, w1) LEFT JOIN un USING (a, b, w2) JOIN vo USING (a, b) GROUP BY doc_id, a, b)"""


def metric_sql(src: str, by: str, auc: bool = False) -> str:
    """CTE ``mt`` with all label metrics of ``src(by, label, prediction[, p1])``."""
    ranks = f""",
ar AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY p1)
  + (count(*) OVER (PARTITION BY {by}, p1) - 1) / 2.0 AS r FROM {src}),
au AS (SELECT {by}, (sum(r) FILTER (label = 1) - n1 * (n1 + 1) / 2.0) / (n0 * n1) AS roc_auc
  FROM ar JOIN (SELECT {by}, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM {src} GROUP BY ALL)
  USING ({by}) GROUP BY {by}, n0, n1)""" if auc else ""
    join = f"LEFT JOIN au USING ({by})" if auc else ""
    return f"""
cf AS (SELECT {by}, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM {src} GROUP BY ALL),
pc AS (SELECT *, coalesce(2.0 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  coalesce(1.0 * tn / nullif(tn + fp, 0), 0) AS r0, coalesce(1.0 * tp / nullif(tp + fn, 0), 0) AS r1,
  coalesce(1.0 * tn / nullif(tn + fn, 0), 0) AS p0, coalesce(1.0 * tp / nullif(tp + fp, 0), 0) AS p1, tn + fp AS n0, fn + tp AS n1 FROM cf){ranks},
mt AS (SELECT {by}, (tp + tn)::DOUBLE / (n0 + n1) AS accuracy, (f0 + f1) / 2 AS f1_macro,
  (n0 * f0 + n1 * f1) / (n0 + n1) AS f1_weighted, (r0 + r1) / 2 AS balanced_accuracy,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
  p1 AS precision, r1 AS recall{', roc_auc' if auc else ''} FROM pc {join})"""


THRESHOLDS = f"""
th AS (SELECT d.doc_id, l.quality AS label, length(d.text) AS c, 'longer_than_' || cut AS model,
  (length(d.text) > cut)::INTEGER AS prediction, length(d.text)::DOUBLE AS p1,
  ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::UBIGINT % 5 AS part
  FROM documents d JOIN labels l USING (doc_id), (VALUES (200), (800), (2000)) v(cut)),
{metric_sql('th', 'model, part', auc=True)}"""
SEED_OF = "CASE part WHEN 0 THEN 42 WHEN 1 THEN 123 WHEN 2 THEN 456 WHEN 3 THEN 789 ELSE 2024 END"


def oracle() -> dict[str, str]:
    columns = {c: f"round(avg({c}), 4) AS {c}_mean" for c in ("accuracy", "f1_macro", "balanced_accuracy", "roc_auc")}
    return {
        "style_signals": f"WITH {style_rows('documents')} SELECT doc_id, {rounded(EXACT)}, meta_hits FROM st",
        "style_prompts": f"WITH {style_rows('conversations', 'conv_id, turn')} SELECT conv_id, turn, {rounded(EXACT)}, meta_hits FROM st",
        "style_composite": f"WITH {style_rows('documents')} SELECT doc_id, has_typos, {rounded(['ai_style'])} FROM st",
        "window_chunks": f"WITH {WINDOWS} SELECT doc_id, pos, n_tokens, md5(text) AS text_md5 FROM wt",
        "chunk_score": f"""WITH {WINDOWS}, p AS (SELECT doc_id, {draw('text')} AS p FROM wt)
SELECT doc_id, round(CASE WHEN count(*) = 1 THEN max(p) ELSE 0.7 * avg(p) + 0.3 * max(p) END, 6) AS p FROM p GROUP BY doc_id""",
        "sentence_consistency": f"""WITH {sentence_rows(4)},
p AS (SELECT doc_id, {draw('text')} AS p FROM se),
a AS (SELECT doc_id, round(avg(p), 6) AS mean, round(count(*) FILTER (p > 0.5)::DOUBLE / count(*), 6) AS ai_frac,
  round(stddev_pop(p), 6) AS std, count(*) AS n_sents FROM p GROUP BY doc_id HAVING count(*) >= 2)
SELECT doc_id, mean, ai_frac, std, n_sents FROM documents LEFT JOIN a USING (doc_id)""",
        "sentence_ppl": f"""WITH {BIGRAM_MODEL},{sentence_rows(3)},{bigram_rows('se', 'doc_id, i', 'q')},
pp AS (SELECT doc_id, i, exp({BIGRAM_NLL}) AS ppl FROM q {BIGRAM_JOINS} GROUP BY doc_id, i),
a AS (SELECT doc_id, round(avg(ppl), 4) AS mean_ppl, round(stddev_pop(ppl), 4) AS std_ppl,
  round(stddev_pop(ppl) / greatest(avg(ppl), 1.0), 4) AS cv FROM pp GROUP BY doc_id HAVING count(*) >= 2)
SELECT doc_id, mean_ppl, std_ppl, cv FROM documents LEFT JOIN a USING (doc_id)""",
        "ensemble_verdict": f"{DECIDED} SELECT doc_id, mode, verdict, agreement, {rounded(['blend', 'shift', 'p_ai', 'confidence', 'model_std'])} FROM dec",
        "verdict_rollup": f"""{DECIDED} SELECT mode, verdict, count(*) AS n_texts, round(avg(confidence), 6) AS mean_confidence
FROM dec GROUP BY ALL""",
        "probability_table": DECIDED + " " + " UNION ALL ".join(
            f"SELECT doc_id, '{model}' AS model, '{cls}' AS class, round(100 * ({expr}), 4) AS percent FROM dec"
            for model, p in (("ensemble", "p_ai"), ("feature_model", "x"), ("detector_1", "o"), ("detector_2", "f"))
            for cls, expr in (("ai", p), ("human", f"1 - {p}"))
        ),
        "kfold": KFOLD,
        "stratified_split": " UNION ALL ".join(
            f"SELECT doc_id, CASE WHEN r < floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split, {s}::INTEGER AS seed FROM ({ranked('toxic', s)})"
            for s in SEEDS
        ),
        "holdout_split": f"""SELECT label, CASE WHEN r < floor(n * 0.1 + 0.5) THEN 'holdout' ELSE 'train' END AS split, count(*) AS n
FROM ({ranked('quality', 42)}) GROUP BY ALL""",
        "smote_rows": f"""WITH {SMOTE}
SELECT dk.vec_id, draw::INTEGER AS draw, nn_id, 1::INTEGER AS label,
  round(list_sum(list_transform(range(1, len(dk.v) + 1), lambda i: dk.v[i] + u * (m.v[i] - dk.v[i]))), 6) AS total
FROM dk JOIN nn ON nn.vec_id = dk.vec_id AND nn.rank = dk.pick JOIN mn m ON m.vec_id = nn.nn_id""",
        "scaled": f"""WITH {VEC}, ex AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM ve),
ms AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM ex GROUP BY dim)
SELECT vec_id, dim::INTEGER AS dim, round((x - m) / s, 6) AS z FROM ex JOIN ms USING (dim)""",
        "knn_classify": f"""WITH {NEAR}
SELECT vec_id, (sum(label) >= 3)::INTEGER AS prediction, round(sum(label) / 5.0, 6) AS p1 FROM nn GROUP BY vec_id""",
        "knn_neighbours": f"WITH {NEAR} SELECT vec_id, nn_id, rank, round(d2, 6) AS d2 FROM nn",
        "knn_recall": "SELECT 5 * count(*) AS n_pairs, TRUE AS enough FROM embeddings",
        "incremental_dedup": """SELECT doc_id, delivery FROM (
  SELECT doc_id, delivery, row_number() OVER (PARTITION BY text ORDER BY turn, doc_id) AS r FROM (
    SELECT doc_id, text, CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' ELSE 'other' END AS delivery,
      CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END AS turn FROM documents)) WHERE r = 1""",
        "sketch_percentiles": """SELECT feature, p, (SELECT count(*) FROM documents) AS n, TRUE AS in_bound
FROM (VALUES ('char_len'), ('word_count'), ('sent_count')) AS f(feature), (VALUES (0.01::DOUBLE), (0.25), (0.5), (0.75), (0.99)) AS q(p)""",
        "gaussian_nb": f"WITH {NB} SELECT vec_id, label, prediction, round(margin, 5) AS margin FROM nb",
        "platt_calibration": f"""WITH RECURSIVE {PLATT},
pr AS (SELECT label, 1 / (1 + exp(a * m + b)) AS p, 1 / (1 + exp(-m)) AS q FROM mg, (SELECT a, b FROM st WHERE i = 80))
SELECT (SELECT round(a, 5) FROM st WHERE i = 80) AS a, (SELECT round(b, 5) FROM st WHERE i = 80) AS b,
  round(avg((p - label) * (p - label)), 6) AS brier, round(avg((q - label) * (q - label)), 6) AS raw_brier FROM pr""",
        "oof_perplexity": f"""WITH {FOLDED.format(kfold=KFOLD)}
SELECT doc_id, fold, round(coalesce(own.ppl, 500.0), 4) AS ppl, round(coalesce(zero.ppl, 500.0), 4) AS ppl_without_fold_0
FROM documents LEFT JOIN fo USING (doc_id) LEFT JOIN pp AS own ON own.doc_id = documents.doc_id AND own.b = coalesce(fold, -1)
LEFT JOIN pp AS zero ON zero.doc_id = documents.doc_id AND zero.b = 0""",
        "oof_idf": f"""WITH fo AS ({KFOLD}),
hb AS (SELECT DISTINCT doc_id, fold, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 384)::INTEGER AS bucket
  FROM (SELECT doc_id, fold, unnest({words('lower(text)')}) AS word FROM documents JOIN fo USING (doc_id))),
gr AS (SELECT w AS without, b AS bucket FROM range(-1, 5) AS t(w), range(384) AS u(b)),
nn AS (SELECT w AS without, count(*) FILTER (fold <> w) AS n FROM fo, range(-1, 5) AS t(w) GROUP BY w),
dd AS (SELECT without, bucket, count(*) AS df FROM hb JOIN gr USING (bucket) WHERE fold <> without GROUP BY ALL)
SELECT without::INTEGER AS without, bucket::INTEGER AS bucket, round(ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1, 9) AS idf
FROM gr JOIN nn USING (without) LEFT JOIN dd USING (without, bucket)""",
        "confusion": f"WITH {NB} SELECT label, prediction, count(*) AS n FROM nb GROUP BY ALL",
        "metric_table": f"""WITH {NB}, sc AS (SELECT 'GaussianNB' AS model, label, prediction FROM nb),{metric_sql('sc', 'model')}
SELECT model, {rounded(['accuracy', 'f1_macro', 'f1_weighted', 'balanced_accuracy', 'mcc', 'precision', 'recall'])} FROM mt""",
        "class_report": f"""WITH {NB}, sc AS (SELECT 'GaussianNB' AS model, label, prediction FROM nb),{metric_sql('sc', 'model')},
r AS (SELECT model, '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM pc
  UNION ALL SELECT model, '1', p1, r1, f1, n1 FROM pc
  UNION ALL SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM pc
  UNION ALL SELECT model, 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
    (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM pc)
SELECT model, class, {rounded(['precision', 'recall', 'f1'])}, support FROM r""",
        "roc_auc": f"""WITH d AS (SELECT l.quality AS label, d.text FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT label, greatest(length(text), 1)::DOUBLE AS char_len, greatest(len({words('text')}), 1)::DOUBLE AS word_count,
  greatest(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '\\S'))), 1)::DOUBLE AS sent_count FROM d),
lng AS (UNPIVOT f ON char_len, word_count, sent_count INTO NAME model VALUE v),
r AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS r FROM lng),
s AS (SELECT model, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, sum(r) FILTER (label = 1) AS r1 FROM r GROUP BY model)
SELECT model, round((r1 - n1 * (n1 + 1) / 2.0) / (n0 * n1), 6) AS roc_auc FROM s""",
        "ranking": f"""WITH {THRESHOLDS},
s AS (SELECT model, {', '.join(columns.values())}, round(stddev_samp(f1_macro), 4) AS f1_macro_std FROM mt GROUP BY model)
SELECT model, accuracy_mean, f1_macro_mean, f1_macro_std, balanced_accuracy_mean, roc_auc_mean,
  round((6 * f1_macro_mean::DECIMAL(10, 4) + 3 * balanced_accuracy_mean::DECIMAL(10, 4) - f1_macro_std::DECIMAL(10, 4))::DECIMAL(12, 4)
    * 0.1::DECIMAL(2, 1), 4)::DOUBLE AS ranking_score FROM s""",
        "stability_summary": f"""WITH {THRESHOLDS}
SELECT model, round(avg(f1_macro), 6) AS f1_mean, round(stddev_pop(f1_macro), 6) AS f1_std, round(min(f1_macro), 6) AS f1_min,
  round(max(f1_macro), 6) AS f1_max, round(max(f1_macro) - min(f1_macro), 6) AS f1_range, round(avg(roc_auc), 6) AS auc_mean,
  round(stddev_pop(roc_auc), 6) AS auc_std, round(avg(balanced_accuracy), 6) AS bal_mean,
  round(stddev_pop(balanced_accuracy), 6) AS bal_std, round(1 - stddev_pop(f1_macro), 6) AS stability_score FROM mt GROUP BY model""",
        "seed_pivot": f"""WITH {THRESHOLDS} SELECT model, """ + ", ".join(
            f"round(max(f1_macro) FILTER ({SEED_OF} = {s}), 6) AS seed_{s}" for s in SEEDS
        ) + " FROM mt GROUP BY model",
    }
