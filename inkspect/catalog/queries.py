"""Registered queries over the supplied tables, one per operator."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspect.functions import text as tx
from inkspect.operators import (
    bigram, blocks, calibration, chunks, classifiers, clean, corpus, ensemble, folds, foldstate, metrics, neighbours,
    profile, ranks, sketches, smote, style,
)
from inkspect.operators.deliveries import Digests
from inkspect.plans import features as ft
from inkspect.plans import scoring, selection
from inkspect.session import scratch_path, shared_dir, spread, staged
from inkspect.sources.tables import labelled, table
from inkspect.streaming.scorer import arriving, score_stream
from inkspect.streaming.scorer import scored as scored_rows


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _stage(spark: SparkSession, d: str, label: str = "quality") -> DataFrame:
    return labelled(spark, d, label)


def r6(name: str):
    return F.round(name, 6).alias(name)


# -- cleaning ---------------------------------------------------------------


def class_overview(spark, d):
    return corpus.overview(clean.clean(_stage(spark, d)))


def clean_docs(spark, d):
    cleaned = clean.clean(_stage(spark, d))
    return cleaned.select("doc_id", "label", F.md5("text").alias("text_md5"))


def exact_dedup(spark, d):
    return clean.keep_first(_docs(spark, d)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


def incremental_dedup(spark, d):
    """Three deliveries, English, then French, then the rest, each against the digests of those before."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    path = scratch_path(spark, "digests")
    name = f"digests_{path[-32:]}"
    store = Digests(spark, name, path, buckets=8)
    deliveries = [("en", "lang = 'en'"), ("fr", "lang = 'fr'"), ("other", "lang NOT IN ('en', 'fr') OR lang IS NULL")]
    out = None
    for delivery, rows in deliveries:
        kept = store.admit(docs.where(rows), delivery).select("doc_id", F.lit(delivery).alias("delivery"))
        kept = staged(kept, "kept")
        out = kept if out is None else out.unionByName(kept)
    spark.sql(f"DROP TABLE {name}")  # its definition; the files stay in the scratch folder
    return out


def min_words(spark, d):
    return clean.long_enough(_docs(spark, d)).select("doc_id", tx.n_tokens(F.col("text")).cast("long").alias("n_words"))


def cleaning_funnel(spark, d):
    return clean.funnel(_stage(spark, d))


def class_balance(spark, d):
    raw = _stage(spark, d)
    parts = [
        clean.class_balance(df).withColumn("phase", F.lit(phase))
        for phase, df in (("raw", raw), ("clean", clean.clean(raw)))
    ]
    return parts[0].unionByName(parts[1])


def word_count_stats(spark, d):
    return clean.word_count_stats(clean.clean(_stage(spark, d)))


def contamination(spark, d):
    bench = table(spark, d, "benchmark")
    return clean.contamination(_docs(spark, d), bench)


def contaminated_rows(spark, d):
    """Documents whose exact text is also a conversation turn or a benchmark item."""
    turns = table(spark, d, "conversations").select("text")
    items = table(spark, d, "benchmark").select("text")
    return clean.contaminated_rows(_docs(spark, d), turns.unionByName(items)).select("doc_id")


def contaminated_sources(spark, d):
    """Documents of the largest source whose exact text another source holds as well."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    inner, outer = docs.where("source = 'src0'"), docs.where("source <> 'src0'")
    return clean.contaminated_rows(inner, outer).select("doc_id")


def clean_langs(spark, d):
    """The whole cleaning chain with language names as labels."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return clean.clean(spread(docs, "doc_id")).select("doc_id", "label", F.md5("text").alias("text_md5"))


def label_encode(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    return clean.encode_labels(docs).select("doc_id", "label")


def normalize_text(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", F.md5(clean.normalize(F.col("html"))).alias("text_md5"))


def html_clean(spark, d):
    pages = spread(table(spark, d, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", F.md5(clean.repair(F.col("html"))).alias("text_md5"))


def input_guard(spark, d):
    turns = table(spark, d, "conversations")
    reason = F.coalesce(clean.guard_reason(F.col("text")), F.lit("accepted"))
    return turns.groupBy("role", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def before_after_hist(spark, d):
    raw = _stage(spark, d)
    return clean.before_after(raw, clean.clean(raw))


# -- profile ----------------------------------------------------------------


def _row_profile(*features):
    def query(spark, d):
        return profile.row_profile(_docs(spark, d)).select("doc_id", *features)

    return query


prof_length = _row_profile("char_len", "word_count", "sent_count", "avg_word_len")
prof_lexical = _row_profile("unique_ratio", "hapax_ratio", "stop_ratio")
prof_chars = _row_profile(
    "punct_density", "question_density", "exclaim_density", "comma_density",
    "cap_ratio", "allcaps_ratio", "digit_ratio", "special_ratio", "quote_density",
)
prof_sentence = _row_profile("avg_sent_len", "sent_len_std", "sent_len_var")
prof_intent = _row_profile("you_ratio", "modal_ratio", "imp_ratio")


def prof_readability(spark, d):
    return profile.row_profile(_docs(spark, d)).select("doc_id", r6("readability"))


def prof_entropy(spark, d):
    docs = _docs(spark, d)
    return profile.profile(docs).select("doc_id", r6("char_entropy"), r6("word_entropy"))


def prof_prompts(spark, d):
    """The profile of prompts: user turns keyed by conversation and turn."""
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return profile.row_profile(spread(turns, "conv_id")).select(
        "conv_id", "turn", "word_count", "you_ratio", "modal_ratio", "imp_ratio"
    )


def word_counts(spark, d):
    counts = profile.word_counts(_docs(spark, d))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("n_words"), F.countDistinct("word").alias("n_distinct"))


def text_stats(spark, d):
    return profile.text_stats(_docs(spark, d))


def _cleaned(spark, d, label="quality"):
    """The stored clean table that the stages after cleaning start from."""
    return staged(clean.clean(_stage(spark, d, label)), "clean")


def _profile(spark, d, label="quality"):
    return profile.profile(spread(_cleaned(spark, d, label), "doc_id"))


def feature_moments(spark, d):
    long = ranks.unpivot(_profile(spark, d), profile.PROFILE_FEATURES, "label")
    return corpus.moments(long).select("feature", "label", "n", r6("mean"), r6("std"))


def _tested(spark, d):
    # Entropies are rounded before ranking: ties must not hang on the last bit.
    wide = _profile(spark, d)
    return wide.select(
        "label",
        *[F.round(f, 9).alias(f) if "entropy" in f or f == "readability" else F.col(f) for f in profile.TESTED_FEATURES],
    )


def mann_whitney_u(spark, d):
    long = ranks.unpivot(_tested(spark, d), profile.TESTED_FEATURES, "label")
    tests = ranks.rank_sums(ranks.cumulative(ranks.value_counts(long)))
    return tests.select("feature", "n_0", "n_1", "u_statistic", r6("z"))


def significance(spark, d):
    return corpus.significance(staged(_tested(spark, d), "profile")).select(
        "feature", r6("mean_0"), r6("mean_1"), r6("std_0"), r6("std_1"),
        "u_statistic", r6("z"), "p_value", "significance",
    )


def significant_features(spark, d):
    return corpus.significant_count(corpus.significance(staged(_tested(spark, d), "profile")))


def percentile_clip(spark, d):
    long = ranks.unpivot(_tested(spark, d), profile.TESTED_FEATURES, "label")
    cum = ranks.cumulative(ranks.value_counts(long))
    return ranks.percentiles(cum, [0.5, 0.99]).select("feature", F.col("p").alias("fraction"), r6("value"))


def sketch_percentiles(spark, d):
    """Percentiles from one stored sketch per source, merged: how many rows, and whether the rank error is in its bound."""
    sources = table(spark, d, "documents").select("doc_id", "source")
    wide = profile.row_profile(_docs(spark, d)).join(sources, "doc_id")
    long = staged(ranks.unpivot(wide, HIST_FEATURES, "source"), "sketch-values")
    stored = staged(sketches.per_slice(long, "source"), "sketches")
    found = sketches.quantiles(sketches.merged(stored), [0.01, 0.25, 0.5, 0.75, 0.99])
    errors = sketches.rank_errors(found, long)
    return errors.select("feature", "p", "n", (F.col("error") <= sketches.ERROR).alias("in_bound"))


# Histograms registered for SQL comparison use integer-valued features, whose
# bin edges both engines compute without rounding differences.
HIST_FEATURES = ["char_len", "word_count", "sent_count"]


def class_histogram(spark, d):
    rows = _profile(spark, d).select("label", *HIST_FEATURES)
    return corpus.histogram(rows, HIST_FEATURES).select("feature", "label", "bin", "n", r6("density"))


def dashboard_histogram(spark, d):
    rows = _tested(spark, d).select("label", *profile.DASHBOARD_FEATURES)
    return corpus.histogram(rows, profile.DASHBOARD_FEATURES, bins=40, per_class=True)


def box_stats(spark, d):
    rows = _profile(spark, d).select("label", *HIST_FEATURES)
    return corpus.box_stats(rows, HIST_FEATURES).select(
        "feature", "label", r6("q1"), r6("median"), r6("q3"), r6("whisker_lo"), r6("whisker_hi"), "n_outliers"
    )


def top_words(spark, d):
    return corpus.top_words(clean.clean(_stage(spark, d)))


def keyword_share(spark, d):
    turns = table(spark, d, "conversations").select("role", "text")
    docs = _stage(spark, d, "toxic").select(F.concat(F.lit("toxic="), "label").alias("role"), "text")
    return corpus.keyword_shares(turns.unionByName(docs), by="role")


def feature_corr(spark, d):
    corr = corpus.correlations(staged(_tested(spark, d), "profile"))
    return corr.select("feature_a", "feature_b", F.round("r", 5).alias("r"))


def vector_summary(spark, d):
    return corpus.vector_summary(table(spark, d, "embeddings"), "embedding", "vec_id").select(
        "vec_id", "dims", "min_value", "max_value", r6("mean_value")
    )


# -- feature blocks ---------------------------------------------------------


def block_b(spark, d):
    return blocks.row_blocks(_docs(spark, d)).select("doc_id", *blocks.BLOCK_B)


def block_c(spark, d):
    rows = blocks.numeric_blocks(_docs(spark, d))
    exact = ["stat_token_div", "stat_repetition", "stat_burstiness", "stat_yule_k"]
    return rows.select("doc_id", *exact, *[r6(c) for c in blocks.BLOCK_C if c not in exact])


def block_d(spark, d):
    return blocks.row_blocks(_docs(spark, d)).select("doc_id", "ling_ent_density", r6("ling_readability"))


def block_f(spark, d):
    return blocks.row_blocks(_docs(spark, d)).select("doc_id", *blocks.BLOCK_F)


def block_a_hashed(spark, d):
    vectors = blocks.hashed_vectors(_docs(spark, d))
    return (
        vectors.select("doc_id", F.posexplode_outer("hashed").alias("bucket", "weight"))
        .where("weight > 0")
        .select("doc_id", "bucket", r6("weight"))
    )


def bigram_ppl(spark, d):
    docs = _docs(spark, d)
    model, own = bigram.fit_own(docs, "doc_id")
    return bigram.block_e(docs, model, own=own).select("doc_id", F.round("ppl", 4).alias("ppl"))


def bigram_ppl_prompts(spark, d):
    """Prompts scored by the documents' model: unseen bigrams fall back to word frequencies."""
    model = bigram.fit(_docs(spark, d))
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id")
    scored = bigram.perplexity(turns, model, "conv_id", "turn")
    return scored.select("conv_id", "turn", F.round("ppl", 4).alias("ppl"))


def feature_vector(spark, d):
    rows = ft.feature_table(_docs(spark, d))
    return rows.select(
        "doc_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total")
    )


def feature_parity(spark, d):
    """Blocks stored at training time and read back against the blocks that scoring builds, every feature of the matrix."""
    docs = _docs(spark, d)
    state = ft.fit_state(docs)
    folder = scratch_path(spark, "blocks")
    ft.stored_blocks(docs, state, folder)  # training
    stored = ft.stored_blocks(docs, state, folder)  # found up to date
    return ft.parity(stored, ft.block_frames(docs, state))


def _folded(spark, d):
    """All documents; those with a quality label have a fold, the others are in no state."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    dealt = folds.kfold(labels).select("doc_id", "fold")
    return spread(staged(_docs(spark, d).join(dealt, "doc_id", "left"), "folded"), "doc_id")


def oof_perplexity(spark, d):
    """Perplexity under the counts of all other folds; unlabelled documents under all folds."""
    docs = _folded(spark, d)
    rows = foldstate.own_perplexities(docs, foldstate.count(docs, 5))
    return docs.select("doc_id", "fold").join(rows, "doc_id").select(
        "doc_id", "fold", F.round(F.get("ppl", F.lit(5)), 4).alias("ppl"),
        F.round(F.get("ppl", F.lit(0)), 4).alias("ppl_without_fold_0"),
    )


def oof_idf(spark, d):
    """Bucket weights without each fold, and of all folds (-1)."""
    tables = foldstate.idf_tables(*foldstate.term_counts(_folded(spark, d), 5), 5)
    rows = [(f, b, w) for f, at in [(-1, 25), *((f, 6 * f) for f in range(5))] for b, w in enumerate(tables[at])]
    return spark.createDataFrame(rows, "without int, bucket int, idf double").select("without", "bucket", F.round("idf", 9).alias("idf"))


# -- style and scoring ------------------------------------------------------

EXACT_SIGNALS = [s for s in style.SIGNALS if s != "has_typos"]


def style_signals(spark, d):
    return style.style_signals(_docs(spark, d)).select("doc_id", *[r6(s) for s in EXACT_SIGNALS], "meta_hits")


def style_prompts(spark, d):
    turns = spread(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id")
    return style.style_signals(turns).select("conv_id", "turn", *[r6(s) for s in EXACT_SIGNALS], "meta_hits")


def style_composite(spark, d):
    return style.style_signals(_docs(spark, d)).select("doc_id", "has_typos", r6("ai_style"))


def window_chunks(spark, d):
    return chunks.windows(_docs(spark, d)).select("doc_id", "pos", "n_tokens", F.md5("text").alias("text_md5"))


def _mock_scorer(df):
    """Reproducible probability from the text's md5, so SQL can repeat it."""
    return df.withColumn("p", F.conv(F.substring(F.md5("text"), 1, 8), 16, 10).cast("long") / float(1 << 32))


def chunk_score(spark, d):
    return chunks.sliding_score(_docs(spark, d), _mock_scorer).select("doc_id", r6("p"))


def sentence_consistency(spark, d):
    rows = chunks.sentence_consistency(_docs(spark, d), _mock_scorer)
    return rows.select(
        "doc_id", *[F.round(f"sent.{c}", 6).alias(c) for c in ("mean", "ai_frac", "std")], "sent.n_sents"
    )


def sentence_ppl(spark, d):
    docs = _docs(spark, d)
    rows = chunks.sentence_perplexity(docs, bigram.fit(docs))
    return rows.select("doc_id", *[F.round(f"ppl.{c}", 4).alias(c) for c in ("mean_ppl", "std_ppl", "cv")])


def _decided(spark, d):
    """Decisions over real style signals and md5-derived probabilities in three bands.

    The hash of the id drives the detectors into every branch of the rules.
    """
    docs = _docs(spark, d)
    h = F.md5(F.col("doc_id").cast("string"))
    draws = {
        name: F.conv(F.substring(h, first, 4), 16, 10).cast("long") / 65536.0
        for name, first in (("x", 1), ("o", 5), ("f", 9))
    }
    signals = style.style_signals(docs).select(
        "doc_id", "meta_hits", "n_words",
        *[F.round(s, 6).alias(s) for s in [*EXACT_SIGNALS, "has_typos"]], r6("ai_style"),
        # the low half of the draws is squared, so near-certain "human" is common
        *[F.when(v < 0.5, v * v).otherwise(v).alias(n) for n, v in draws.items()],
        F.lit(None).cast("struct<mean:double,ai_frac:double,std:double>").alias("sent"),
        F.lit(None).cast("struct<low_ppl_signal:double,low_var_signal:double>").alias("ppl"),
    )
    return ensemble.decide(signals)


def ensemble_verdict(spark, d):
    return _decided(spark, d).select(
        "doc_id", "mode", "verdict", "agreement", *[r6(c) for c in ("blend", "shift", "p_ai", "confidence", "model_std")]
    )


def verdict_rollup(spark, d):
    return ensemble.verdict_rollup(_decided(spark, d)).select("mode", "verdict", "n_texts", r6("mean_confidence"))


def probability_table(spark, d):
    return ensemble.probability_table(_decided(spark, d)).select("doc_id", "model", "class", F.round("percent", 4).alias("percent"))


def _models(spark, d):
    """All scoring models; the feature model of the first stage is the champion of the stored ranking."""
    champion = _ranking(spark, d).first()["model"]
    return scoring.train(_cleaned(spark, d), _cleaned(spark, d, "toxic"), champions=(champion, "LogisticRegression"))


def score_documents(spark, d):
    scored = scoring.score(_docs(spark, d), _models(spark, d))
    return scored.select("doc_id", "reason", "x", "o", "f", "mode", "p_ai", "verdict", "agreement", "intent", "stage2_applicable")


def stream_scores(spark, d):
    models = _models(spark, d)
    base = scratch_path(spark, "stream")
    source = arriving(spark, d, pattern="documents.parquet")
    query = score_stream(source, models, f"{base}/scores", f"{base}/checkpoint", once=True)
    query.awaitTermination()
    return scored_rows(spark, f"{base}/scores").select("doc_id", "batch_id", "reason", "mode", "p_ai", "verdict", "intent")


# -- selection --------------------------------------------------------------


def kfold(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return folds.kfold(labels).select("doc_id", "label", "fold")


def stratified_split(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    out = None
    for seed in selection.SEEDS:
        part = folds.split(labels, 0.2, seed).select("doc_id", "split", F.lit(seed).alias("seed"))
        out = part if out is None else out.unionByName(part)
    return out


def holdout_split(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return folds.holdout(labels).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, d):
    """Embedding rows with label 1 for class 0 and 0 for the rest."""
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("label") == 0, 1).otherwise(0).alias("label")
    )


def smote_rows(spark, d):
    rows = smote.synthesize(_vectors(spark, d), id_col="vec_id")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", "draw", "nn_id", "label", F.round(total, 6).alias("total"))


def scaled(spark, d):
    rows = classifiers.scale(_vectors(spark, d), "vec_id", "v")
    return rows.select("vec_id", F.posexplode_outer("z").alias("dim", "z")).select("vec_id", "dim", r6("z"))


def knn_classify(spark, d):
    """Leave-one-out 5-NN vote on the embeddings."""
    rows = _vectors(spark, d)
    found = neighbours.nearest(rows, rows, 5, "vec_id", "v", skip_self=True)
    return neighbours.classify(found, rows, "vec_id").select(F.col("qid").alias("vec_id"), "prediction", r6("p1"))


def knn_neighbours(spark, d):
    """The same neighbours by way of cells and blocks."""
    rows = _vectors(spark, d)
    found = neighbours.nearest(rows, rows, 5, "vec_id", "v", skip_self=True, max_broadcast_bytes=0, block_rows=256)
    return found.select(F.col("qid").alias("vec_id"), F.col("pid").alias("nn_id"), "rank", r6("d2"))


def knn_recall(spark, d):
    """The approximate neighbours against the exact ones."""
    rows = _vectors(spark, d)
    exact = neighbours.nearest(rows, rows, 5, "vec_id", "v", skip_self=True).select("qid", "pid")
    near = neighbours.nearest(rows, rows, 5, "vec_id", "v", skip_self=True, method="probes").select("qid", "pid", F.lit(1).alias("hit"))
    found = exact.join(near, ["qid", "pid"], "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("hit").alias("hits"))
    return found.select("n_pairs", (F.col("hits") >= 0.9 * F.col("n_pairs")).alias("enough"))


def _nb(spark, d):
    return classifiers.gaussian_nb(_vectors(spark, d), "vec_id", "v")


def gaussian_nb(spark, d):
    return _nb(spark, d).select("vec_id", "label", "prediction", F.round("margin", 5).alias("margin"))


def confusion(spark, d):
    return metrics.confusion(_nb(spark, d))


def metric_table(spark, d):
    out = metrics.binary_metrics(_nb(spark, d).withColumn("model", F.lit("GaussianNB")), "model")
    return out.select("model", *[r6(m) for m in metrics.METRICS if m != "roc_auc"])


def class_report(spark, d):
    out = metrics.report(_nb(spark, d).withColumn("model", F.lit("GaussianNB")), "model")
    return out.select("model", "class", *[r6(c) for c in ("precision", "recall", "f1")], "support")


def roc_auc(spark, d):
    """Three length measures as scores for the quality label."""
    wide = profile.row_profile(_stage(spark, d)).select("label", *HIST_FEATURES)
    long = ranks.unpivot(wide, HIST_FEATURES, "label")
    scores = long.select(F.col("feature").alias("model"), F.col("value").alias("score"), "label")
    return ranks.roc_auc(scores).select("model", r6("roc_auc"))


def _threshold_scores(spark, d, group):
    """Predictions from document length under md5-assigned groups: real labels, no fit."""
    docs = _stage(spark, d).select("doc_id", "label", F.length("text").alias("c"))
    cuts = F.array(*[F.struct(F.lit(f"longer_than_{c}").alias("model"), F.lit(c).alias("cut")) for c in (200, 800, 2000)])
    rows = docs.select("doc_id", "label", "c", F.inline(cuts))
    return rows.select(
        "doc_id", "label", "model", (F.col("c") > F.col("cut")).cast("int").alias("prediction"),
        F.col("c").cast("double").alias("p1"), group.alias("part"),
    )


def _part(k):
    return F.pmod(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def ranking(spark, d):
    per_fold = selection.evaluate(_threshold_scores(spark, d, _part(5)), "model", "part")
    return metrics.fold_summary(per_fold).select(
        "model", "accuracy_mean", "f1_macro_mean", "f1_macro_std", "balanced_accuracy_mean", "roc_auc_mean", "ranking_score"
    )


def _per_seed(spark, d):
    rows = selection.evaluate(_threshold_scores(spark, d, _part(5)), "model", "part")
    seed = F.get(F.array(*[F.lit(s) for s in selection.SEEDS]), F.col("part"))
    return rows.select("model", seed.alias("seed"), "f1_macro", "roc_auc", "balanced_accuracy")


def stability_summary(spark, d):
    out = metrics.stability_summary(_per_seed(spark, d))
    return out.select("model", *[r6(c) for c in out.columns if c not in ("model", "stability_score")], "stability_score")


def seed_pivot(spark, d):
    out = metrics.seed_matrix(_per_seed(spark, d), selection.SEEDS)
    return out.select("model", *[F.round(F.col(f"`{s}`"), 6).alias(f"seed_{s}") for s in selection.SEEDS])


def _holdout_of_vectors(name, **options):
    """A classifier fitted on 90% of the embeddings, the scores of the other 10%."""

    def query(spark, d):
        vectors = _vectors(spark, d).withColumn("features", array_to_vector("v"))
        parts = staged(folds.holdout(vectors, id_col="vec_id"), "vector-parts")
        model = classifiers.fit(name, parts.where("split = 'train'"), **options)
        held = model.apply(parts.where("split = 'holdout'"))
        return held.select("vec_id", "label", "prediction", F.round("p1", 9).alias("p1"))

    return query


svm_vectors = _holdout_of_vectors("SVM_Linear", maxIter=20)
random_forest_vectors = _holdout_of_vectors("RandomForest")
extra_trees_vectors = _holdout_of_vectors("ExtraTrees")
ada_boost_vectors = _holdout_of_vectors("AdaBoost", rounds=20)
gradient_boosting_vectors = _holdout_of_vectors("GradientBoosting", maxIter=20)
hist_boosting_vectors = _holdout_of_vectors("HistBoosting", rounds=10, depth=3)
mlp_vectors = _holdout_of_vectors("MLP")


def platt_calibration(spark, d):
    """The sigmoid over the margins of naive Bayes and what it does to the Brier score."""
    margins = staged(
        _nb(spark, d).select("label", F.when(F.col("prediction") == 1, F.col("margin")).otherwise(-F.col("margin")).alias("margin")), "nb-margins"
    )
    a, b = calibration.fit_sigmoid(margins)
    scored = margins.withColumn("p1", calibration.sigmoid(F.col("margin"), a, b))
    raw = margins.withColumn("p1", 1 / (1 + F.exp(-F.col("margin"))))
    return calibration.brier(scored).select(
        F.lit(round(a, 5)).alias("a"), F.lit(round(b, 5)).alias("b"), r6("brier"),
    ).crossJoin(calibration.brier(raw).select(F.round("brier", 6).alias("raw_brier")))


_split_tables: dict[tuple[str, str], selection.Splits] = {}


def _splits(spark, d):
    """Holdout, folds and their states, made once per session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _split_tables:
        _split_tables[key] = selection.Splits(_cleaned(spark, d))
    return _split_tables[key]


def _ledger(spark, d, name):
    """Where the finished units of a loop are kept, for the other queries of the session."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{abs(hash(d))}"


def _ranking(spark, d):
    """All classifiers on five folds of the training side, best first."""
    per_fold = _splits(spark, d).screen(classifiers.NAMES, metric_path=_ledger(spark, d, "screening"))
    return metrics.fold_summary(per_fold)


def screening(spark, d):
    return _ranking(spark, d)


def stability_run(spark, d):
    """The five best of the stored ranking under five seeds."""
    best = [r["model"] for r in metrics.top_models(_ranking(spark, d), selection.TOP).collect()]
    texts = staged(_cleaned(spark, d), "stability-texts")
    return selection.stability(
        texts, best, matrix=lambda seed: selection.seed_matrix(texts, seed), metric_path=_ledger(spark, d, "stability")
    )


def final_model(spark, d):
    """The champion on the holdout that no state and no choice has seen."""
    parts, ranked = _splits(spark, d).final(), _ranking(spark, d)
    _, _, report = selection.train_final(parts, ranked, scratch_path(spark, "champion"))
    return report
