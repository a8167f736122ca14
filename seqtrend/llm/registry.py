"""The corpus operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from seqtrend.llm import clustering, decontaminate, divergence, mixing, nearest, secrets, sharding, simhash_dedup, substring_dedup
from seqtrend.llm import token_counts, token_output, toxicity, warc

QUERIES = {
    "op1_token_output": token_output.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_mixing": mixing.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_counts": token_counts.op6,
    "op7_nearest": nearest.op7,
    "op8_simhash_dedup": simhash_dedup.op8,
    "op9_sharding": sharding.op9,
    "op10_secrets": secrets.op10,
    "op11_clustering": clustering.op11,
    "op12_warc": warc.op12,
    "op13_divergence": divergence.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op9_sharding": sharding.OP9_SQL,
    "op11_clustering": clustering.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
