"""The registered query of each operator, with its SQL where SQL can express it."""

import corpus_pipeline
from areastats.llm import (
    centroids,
    chat,
    interaction,
    jaccard,
    language_model,
    licences,
    lines,
    mixing,
    neighbours,
    packing,
    quality,
    rules,
    urls,
)

OPERATORS = {
    "op1_chat_formatting": chat,
    "op2_licence_scan": licences,
    "op3_mix_sources": mixing,
    "op4_embedding_near_dedup": neighbours,
    "op5_url_filters": urls,
    "op6_quality_classifier": quality,
    "op7_jaccard_join": jaccard,
    "op8_best_fit_packing": packing,
    "op9_quality_rules": rules,
    "op10_lm_scoring": language_model,
    "op11_centroid_clustering": centroids,
    "op12_line_dedup": lines,
    "op13_filter_interaction": interaction,
}

QUERIES = {name: module.query for name, module in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {name: module.ORACLE for name, module in OPERATORS.items() if module.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
