"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import crf_extraction, exact_topk, kneser_ney, log_templates, ngram_jaccard, packing, permutation_index, piece_lattice, surrogates, token_alignment, token_counts, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
        "op2_piece_lattice": piece_lattice.op2_piece_lattice,
        "op3_warc": warc.op3_warc,
        "op4_permutation_index": permutation_index.op4_permutation_index,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_packing": packing.op6_packing,
        "op7_surrogates": surrogates.op7_surrogates,
        "op8_log_templates": log_templates.op8_log_templates,
        "op9_exact_topk": exact_topk.op9_exact_topk,
        "op10_kneser_ney": kneser_ney.op10_kneser_ney,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_crf_extraction": crf_extraction.op12_crf_extraction,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_log_templates": log_templates.OP8_SQL, "op9_exact_topk": exact_topk.OP9_SQL}
