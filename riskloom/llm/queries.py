"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from riskloom.llm import conversations, decontamination, exact_dedup, filter_audit, minhash, mixing, packing, quality, secrets, substring_dedup, token_counts, token_store, toxicity
from riskloom.llm.common import documents, scratch_path, table

TOKENIZER = "word_bpe_49k.json"
STORE_END, PACK_END, FLAT_END = 2, 1, 49407


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("raw", "stays")


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_token_store(spark, sf_dir):
    out = scratch_path(spark, "token-store")
    token_store.write_token_store(documents(spark, sf_dir), out, tokenizer_path(), STORE_END)
    return token_store.read_token_store(spark, out)


def op4_benchmark_decontamination(spark, sf_dir):
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    out = scratch_path(spark, "flat-tokens")
    token_counts.write_flat(documents(spark, sf_dir), out, tokenizer_path(), FLAT_END)
    return token_counts.document_counts(spark, out, FLAT_END)


def op6_quality_resampling(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), 4096, PACK_END)


def op9_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(documents(spark, sf_dir))


def op11_source_mix(spark, sf_dir):
    return mixing.mix_sources(documents(spark, sf_dir))


def op12_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair_conversations(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_store": op3_token_store,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_mix": op11_source_mix,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
    "op13_conversation_repair": conversations.ORACLE_SQL,
}
