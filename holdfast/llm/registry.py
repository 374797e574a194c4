"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import (
    decontaminate,
    exact_dedup,
    lm_score,
    packing,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)

QUERIES = {
    "op1_hmm_score": lm_score.op1,
    "op2_toxicity": toxicity.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_token_files": token_files.op5,
    "op6_packing": packing.op6,
    "op7_quality": quality.op7,
    "op8_sharding": sharding.op8,
    "op9_suffix_dedup": suffix_dedup.op9,
    "op10_simhash": simhash.op10,
}

SQL = {"op4_exact_dedup": exact_dedup.SQL}
