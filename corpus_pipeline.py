"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read again by the next.

toxicity: documents predicted toxic go. exact dedup: of equal texts the largest doc_id stays. n-gram Jaccard join: of each
group of near copies the smallest doc_id stays. substring dedup: passages that an earlier document has are cut out.
best-fit packing: what is left, as token pieces in sequences. The dedup stages drop rows, not ids: a row is told by its doc_id and
text, so another text under a dropped row's id stays, and of rows that repeat both, one stays. Rows without a doc_id stay if their
whole group has none (of equal texts: one of them). An empty table passes all stages as an empty one; null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltscope.llm.common import documents, saved
from siltscope.llm.exact_dedup import exact_dedup
from siltscope.llm.jaccard_join import jaccard_join
from siltscope.llm.packing import pack
from siltscope.llm.queries import byte_bpe
from siltscope.llm.substring_dedup import without_repeats
from siltscope.llm.toxicity import without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: 0: the row goes, 1: one of these rows stays
VERDICT = "_row_verdict"


def judged(docs: DataFrame, text_key: Column, verdicts: DataFrame) -> DataFrame:
    """``docs`` by verdicts(doc_id, text_key, VERDICT) on some of their rows, others stay."""
    key = docs.withColumn("_text_key", text_key)
    v = verdicts.select(F.col("doc_id").alias("_v_doc"), F.col("text_key").alias("_v_key"), VERDICT)
    j = key.join(v, F.col("doc_id").cast("long").eqNullSafe(F.col("_v_doc")) & (F.col("_text_key") == F.col("_v_key")), "left")
    rest = j.filter(F.col(VERDICT).isNull()).select(*docs.columns)
    one = j.filter(F.col(VERDICT) == 1).dropDuplicates(["_v_doc", "_v_key"]).select(*docs.columns)
    return rest.unionByName(one)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that the operator keeps; where it keeps several, one."""
    marks = exact_dedup(docs).filter("group_size > 1").groupBy("doc_id", F.col("text_sha256").alias("text_key")).agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    verdicts = marks.filter("NOT kept OR n > 1").select("doc_id", "text_key", F.col("kept").cast("int").alias(VERDICT))
    return judged(docs, F.sha2(F.coalesce("text", F.lit("")), 256), verdicts)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the rows under its id stay: one, where ids are not repeated."""
    rows = jaccard_join(docs).filter("n_shingles > 0 AND component_id IS NOT NULL AND NOT doc_id <=> component_id")
    return judged(docs, F.xxhash64(F.coalesce("text", F.lit(""))), rows.select("doc_id", "text_key").distinct().withColumn(VERDICT, F.lit(0)))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, byte_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("substring_dedup", passages),
    ("best_fit_packing", sequences),
]

#: toxicity is learned and packing is a search: no SQL gives these rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
