"""From raw documents to packed training sequences: the stages, in order.

Every stage takes the documents that its predecessor kept, all of them, and decides by their texts:

1. ``language_id`` drops documents without letters and those in no learned language;
2. ``quality`` drops documents whose quality score is below the threshold;
3. ``near_duplicates`` keeps one document of each group of near-duplicates: links are a Jaccard similarity of five-word shingles
   of at least 0.8 (the query of op6 has a contract of its own, four words and 0.85);
4. ``secrets`` masks secrets in the texts and updates ``n_chars``;
5. ``packing`` cuts and packs the ids of all documents into sequences.

Defined cases: null and empty texts have no letters and are dropped by the first stage; null ids are kept; repeated rows are
near-duplicates, one stays; an empty table stays empty; extra columns are kept up to the last stage. Where nothing can be learned
(no document with a language, no labels of both kinds), a filtering stage keeps everything it cannot judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import jaccard, langid, packing, quality, secrets
from shelfwise.llm.common import table, tuned, with_columns_of_text
from shelfwise.llm.pieces import tokenizer_path
from shelfwise.llm.queries import BYTE_BPE
from shelfwise.llm.registry import query
from shelfwise.session import materialized

# Near-duplicates: words of a shingle, and the least Jaccard similarity in percent.
WIDTH = 5
PERCENT = 80
# Pieces of text that a packing worker remembers: executors of the earlier stages have grown by then, and workers keep what they remember.
MEMO_ENTRIES = 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    model = langid.learn(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return kept(docs, spark.sparkContext.broadcast(model), langid.LanguageModel.recognises)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return kept(docs, spark.sparkContext.broadcast(model), quality.QualityModel.accepts)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return jaccard.one_of_each_group(docs, WIDTH, PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return packing.pack_examples(docs, tokenizer_path(BYTE_BPE), kind="byte", end_id=0, memo_entries=MEMO_ENTRIES)


def kept(docs: DataFrame, sent, accepts) -> DataFrame:
    """Rows whose text the broadcast model accepts."""
    rows = with_columns_of_text(docs, "__kept boolean", lambda texts: [accepts(sent.value, texts)])
    return rows.where("__kept").select(docs.columns)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# Models, token ids and near-duplicate groups have no SQL form. Tests check near-duplicates on a small fixture against known groups; the
# other stages are tested as operators, not as stages against brute force.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
