"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltscope.llm.brown import op5_brown_score
from siltscope.llm.common import documents
from siltscope.llm.exact_dedup import exact_dedup
from siltscope.llm.fill_middle import OP13_SQL, op13_fill_middle
from siltscope.llm.jaccard_join import op7_ngram_jaccard_join
from siltscope.llm.language_id import op6_language_id
from siltscope.llm.licenses import op4_license_scan
from siltscope.llm.merkle import OP11_SQL, op11_merkle_manifest
from siltscope.llm.packing import pack
from siltscope.llm.quality import OP9_SQL, op9_quality_rules
from siltscope.llm.secrets import op12_secret_scan
from siltscope.llm.sentencepiece_scan import op3_sentencepiece_scan
from siltscope.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from siltscope.llm.toxicity import op2_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def byte_bpe() -> str:
    """The public byte-level vocabulary; a file of the installed environment on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), byte_bpe())


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece_scan": op3_sentencepiece_scan,
    "op4_license_scan": op4_license_scan,
    "op5_brown_score": op5_brown_score,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES: dict[str, str] = {
    "op8_exact_dedup": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
