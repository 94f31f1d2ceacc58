"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.chat_format import OP7_SQL, op7_chat_format
from textloom.llm.imatch import op9_imatch
from textloom.llm.ngram_jaccard import op1_ngram_jaccard
from textloom.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from textloom.llm.quality_gam import op2_quality_gam
from textloom.llm.quality_rules import OP10_SQL, op10_quality_rules
from textloom.llm.sentence_pieces import op5_sentence_pieces
from textloom.llm.simhash import op12_simhash_golay
from textloom.llm.source_mixing import OP3_SQL, op3_source_mixing
from textloom.llm.suffix_dedup import op8_suffix_dedup
from textloom.llm.token_shards import op4_token_shards
from textloom.llm.vector_codes import OP11_SQL, op11_vector_codes
from textloom.llm.warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_ngram_jaccard, op2_quality_gam, op3_source_mixing, op4_token_shards, op5_sentence_pieces, op6_warc, op7_chat_format, op8_suffix_dedup, op9_imatch, op10_quality_rules, op11_vector_codes, op12_simhash_golay, op13_prefix_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mixing": OP3_SQL, "op6_warc": OP6_SQL, "op7_chat_format": OP7_SQL, "op10_quality_rules": OP10_SQL, "op11_vector_codes": OP11_SQL, "op13_prefix_trie": OP13_SQL}
