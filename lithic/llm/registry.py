"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lithic.llm import chat, embedding_dedup, exact_dedup, lm_score, mixing, packing, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_warc_fixity": warc.op2_warc_fixity,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_chat_format": chat.op4_chat_format,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_simhash": simhash.op7_simhash,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_packing": packing.op10_packing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_fixity": warc.ORACLE, "op4_chat_format": chat.ORACLE, "op5_embedding_dedup": embedding_dedup.ORACLE, "op6_exact_dedup": exact_dedup.oracle(), "op8_mixing": mixing.oracle()}
