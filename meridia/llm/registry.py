"""Queries of the text operators and their SQL."""

from __future__ import annotations

from . import codes, decontam, jaccard, licenses, mixing, pages, passages, periods, pivots, quality, secrets, tokens, toxicity
from .common import table


def queries():
    import corpus_pipeline

    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_quality_rules": lambda s, d: quality.quality_table(docs(s, d)),
        "op2_decontamination": lambda s, d: decontam.contamination(docs(s, d), table(s, d, "benchmark")),
        "op3_source_mix": lambda s, d: mixing.mix_table(docs(s, d)),
        "op4_secrets": lambda s, d: secrets.secret_table(docs(s, d)),
        "op5_ngram_jaccard": lambda s, d: jaccard.jaccard_classes(docs(s, d)),
        "op6_toxicity": lambda s, d: toxicity.toxicity_table(docs(s, d), table(s, d, "labels")),
        "op7_passages": lambda s, d: passages.removed(docs(s, d)),
        "op8_licenses": lambda s, d: licenses.license_table(docs(s, d)),
        "op10_pages": lambda s, d: pages.page_table(table(s, d, "pages")),
        "op9_token_ids": lambda s, d: tokens.token_table(docs(s, d)),
        "op11_periodic_runs": lambda s, d: periods.run_table(docs(s, d)),
        "op12_pivot_index": lambda s, d: pivots.near_copies(table(s, d, "embeddings")),
        "op13_vector_codes": lambda s, d: codes.code_table(table(s, d, "embeddings")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op3_source_mix": mixing.ORACLE}
