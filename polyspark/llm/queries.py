"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from polyspark.llm import (
    embedding_dedup,
    merkle,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    sentencepiece_codec,
    simhash,
    substring_dedup,
    token_output,
    tokenizer_alignment,
    url_filters,
    warc,
)


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_simhash": simhash.query,
        "op3_quality_classifier": quality_classifier.query,
        "op4_embedding_dedup": embedding_dedup.query,
        "op5_pii": pii.query,
        "op6_token_output": token_output.query,
        "op7_sentencepiece": sentencepiece_codec.query,
        "op8_url_filters": url_filters.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_mixing": mixing.query,
        "op11_warc": warc.query,
        "op12_merkle": merkle.query,
        "op13_tokenizer_alignment": tokenizer_alignment.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op8_url_filters": url_filters.SQL,
        "op10_mixing": mixing.SQL,
        "op11_warc": warc.SQL,
        "op12_merkle": merkle.SQL,
    }
