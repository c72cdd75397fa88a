"""Names of all registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkspect.catalog import queries as q

NAMES = [
    "class_overview", "clean_docs", "exact_dedup", "incremental_dedup", "min_words", "cleaning_funnel", "class_balance",
    "word_count_stats", "contamination", "contaminated_rows", "contaminated_sources", "clean_langs", "label_encode", "normalize_text",
    "html_clean", "input_guard", "before_after_hist",
    "prof_length", "prof_lexical", "prof_chars", "prof_sentence", "prof_entropy", "prof_intent",
    "prof_readability", "prof_prompts", "word_counts", "text_stats",
    "feature_moments", "mann_whitney_u", "significance", "significant_features", "percentile_clip",
    "class_histogram", "dashboard_histogram", "box_stats", "top_words", "keyword_share",
    "feature_corr", "vector_summary", "sketch_percentiles",
    "block_a_hashed", "block_b", "block_c", "block_d", "block_f", "bigram_ppl", "bigram_ppl_prompts",
    "feature_vector", "feature_parity", "oof_perplexity", "oof_idf",
    "style_signals", "style_prompts", "style_composite", "window_chunks", "chunk_score",
    "sentence_consistency", "sentence_ppl", "ensemble_verdict", "verdict_rollup", "probability_table",
    "kfold", "stratified_split", "holdout_split", "smote_rows", "scaled", "knn_classify",
    "knn_neighbours", "knn_recall", "gaussian_nb", "confusion", "metric_table", "class_report", "roc_auc",
    "ranking", "stability_summary", "seed_pivot",
    "platt_calibration", "svm_vectors", "random_forest_vectors", "extra_trees_vectors", "ada_boost_vectors",
    "gradient_boosting_vectors", "hist_boosting_vectors", "mlp_vectors",
    "screening", "stability_run", "final_model", "score_documents", "stream_scores",
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in NAMES}
