"""Record contracts and the constants of the evaluation protocol."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the per-record scores, in contract order.
SCORE_FIELDS = [
    "overall_precision",
    "overall_recall",
    "overall_f1",
    "claim_recall",
    "context_precision",
    "context_utilization",
    "self_knowledge",
    "noise_sensitivity_relevant",
    "noise_sensitivity_irrelevant",
    "hallucination",
    "faithfulness",
]

# Per-record score name -> name in aggregated records.
SHORT_NAME = {
    "overall_precision": "overall_precision",
    "overall_recall": "overall_recall",
    "overall_f1": "overall_f1",
    "claim_recall": "claim_recall",
    "context_precision": "context_precision",
    "context_utilization": "cu",
    "self_knowledge": "sk",
    "noise_sensitivity_relevant": "ns_relevant",
    "noise_sensitivity_irrelevant": "ns_irrelevant",
    "hallucination": "hallucination",
    "faithfulness": "faithfulness",
}

# Name a judge reports -> per-record score name.
JUDGE_NAME = {
    "precision": "overall_precision",
    "recall": "overall_recall",
    "f1": "overall_f1",
    "claim_recall": "claim_recall",
    "context_precision": "context_precision",
    "context_utilization": "context_utilization",
    "noise_sensitivity_in_relevant": "noise_sensitivity_relevant",
    "noise_sensitivity_in_irrelevant": "noise_sensitivity_irrelevant",
    "hallucination": "hallucination",
    "self_knowledge": "self_knowledge",
    "faithfulness": "faithfulness",
}

METRICS = list(SHORT_NAME.values())
GAP_METRIC = "preference_gap"

# The configuration key and the pairing key inside it.
CONFIG_KEY = ["model", "quantization", "dataset", "subset", "pass"]
PAIR_KEY = ["model", "quantization", "dataset", "subset"]

# Protocol vocabulary.
PASSES = ["pass1_baseline", "pass2_loose", "pass3_strict"]
SOURCES = ["local", "api"]
PROVIDERS = ["openai", "anthropic"]
QUANT_AXIS = ["Q3_K_M", "Q4_K_M", "Q5_K_M", "Q6_K", "Q8_0", "FP16"]
ERROR_CATEGORIES = [
    "model_load",
    "kv_cache_oom",
    "generation_timeout",
    "malformed_output",
    "server_crash",
    "scoring_failure",
]

# Statistics and retrieval settings.
BOOTSTRAP_RESAMPLES = 1000
CONFIDENCE_LEVEL = 0.95
BOOTSTRAP_SEED = 42
DEGRADED_BELOW = 0.30
KAPPA_THRESHOLD = 0.80
PRACTICAL_DELTA = 0.05
CI_WIDTH_SHARE = 0.15
CHUNK_WORDS = 300
CHUNK_OVERLAP = 64
TOP_K = 5

# Prompt templates per pass, {query} and {context} are placeholders.
PROMPTS = [
    {
        "pass": "pass1_baseline",
        "system": None,
        "user": "{query}",
        "include_context": False,
    },
    {
        "pass": "pass2_loose",
        "system": None,
        "user": "I have some background information that might be helpful:\n"
                "{context}\n\nBased on that, {query}\n",
        "include_context": True,
    },
    {
        "pass": "pass3_strict",
        "system": "Answer using ONLY the provided context. If the answer is not in the context, "
                  "say \"I do not know.\"",
        "user": "Context:\n{context}\n\n{query}\n",
        "include_context": True,
    },
]


def _s(name: str, dtype: T.DataType | None = None) -> T.StructField:
    return T.StructField(name, dtype or T.StringType(), True)


SCORES = T.StructType([_s("ragchecker", T.StructType([_s(f, T.DoubleType()) for f in SCORE_FIELDS]))])

RAW_RECORD = T.StructType([
    _s("run_id"), _s("timestamp"), _s("model"), _s("quantization"), _s("source"), _s("provider"),
    _s("dataset"), _s("subset"), _s("pass"), _s("seed", T.IntegerType()), _s("query_id"), _s("query"),
    _s("context_chunks", T.ArrayType(T.StringType())), _s("ground_truth"), _s("response"),
    _s("generation_time_ms", T.DoubleType()), _s("scores", SCORES),
    _s("response_model"), _s("judge_model"), _s("error"), _s("error_detail"),
])

NORMALIZED_SAMPLE = T.StructType([
    _s("query_id"), _s("sample_id"), _s("id"), _s("query"), _s("question"), _s("ground_truth"),
    _s("answer"), _s("subset"),
    _s("metadata", T.StructType([
        _s("original_passages", T.ArrayType(T.StringType())), _s("knowledge"),
    ])),
])

METRIC_STATS = T.StructType([_s(f, T.DoubleType()) for f in ("mean", "ci_lo", "ci_hi", "std")])

AGGREGATED_RECORD = T.StructType([
    _s("model"), _s("quantization"), _s("source"), _s("dataset"), _s("subset"), _s("pass"),
    _s("n_queries", T.LongType()), _s("metrics", T.MapType(T.StringType(), METRIC_STATS)),
    _s("capability_degraded", T.BooleanType()),
])

REGISTRY = T.MapType(T.StringType(), T.StructType([
    _s("display_name"), _s("params"), _s("role"),
    _s("quants", T.MapType(T.StringType(), T.StringType())),
]))
