"""The operators as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, embeddings, licenses, lines, mixing, packing, quality, repair, simhash, substring, tokenfile, toxicity
from .common import documents

QUERIES = {
    "op1_chat_formatting": lambda spark, sf_dir: chat.op1_chat_formatting(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op2_bestfit_packing": lambda spark, sf_dir: packing.op2_bestfit_packing(documents(spark, sf_dir)),
    "op3_token_file": lambda spark, sf_dir: tokenfile.op3_token_file(documents(spark, sf_dir)),
    "op4_source_mixing": lambda spark, sf_dir: mixing.op4_source_mixing(documents(spark, sf_dir)),
    "op5_embedding_neardup": lambda spark, sf_dir: embeddings.op5_embedding_neardup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op6_license_scan": lambda spark, sf_dir: licenses.op6_license_scan(documents(spark, sf_dir)),
    "op7_quality_rules": lambda spark, sf_dir: quality.op7_quality_rules(documents(spark, sf_dir)),
    "op8_toxicity": lambda spark, sf_dir: toxicity.op8_toxicity(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ),
    "op9_substring_dedup": lambda spark, sf_dir: substring.op9_substring_dedup(documents(spark, sf_dir)),
    "op10_simhash_neardup": lambda spark, sf_dir: simhash.op10_simhash_neardup(documents(spark, sf_dir)),
    "op11_conversation_repair": lambda spark, sf_dir: repair.op11_conversation_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op12_line_dedup": lambda spark, sf_dir: lines.op12_line_dedup(documents(spark, sf_dir)),
    "op13_source_divergence": lambda spark, sf_dir: divergence.op13_source_divergence(documents(spark, sf_dir)),
}

ORACLE_SQL = {"op1_chat_formatting": chat.ORACLE, "op4_source_mixing": mixing.ORACLE, "op11_conversation_repair": repair.ORACLE, "op12_line_dedup": lines.ORACLE, "op13_source_divergence": divergence.ORACLE}
