"""From raw documents to packed training sequences: quality, line dedup, near duplicates, private data, packing.

Each stage takes (spark, docs, sf_dir), docs being the table its predecessor left, and all but the last return the
columns of documents; n_chars follows the text. A document that a stage rejects is gone for the next.

Quality is judged by all documents that labels call good: all of them are counted and all set the thresholds.

Defined results: documents whose lines were all dropped go with them; blank texts are rejected with the bad ones.
Of near duplicates the smallest doc_id stays, of rows with equal id and text one; rows without an id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, kneser_ney, log_templates, ngram_jaccard, packing, surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    decided = kneser_ney.classify(docs, common.table(spark, sf_dir, "labels"))
    rejected = common.stored(decided.where("not keep").select("row_key").distinct(), "rejected")
    return docs.withColumn("row_key", kneser_ney.row_key()).join(rejected, "row_key", "left_anti").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = log_templates.drop_recurring_lines(docs).where("n_dropped = 0 or trim(text) <> ''")
    return _with_text(left)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = common.stored(ngram_jaccard.join(docs), "components")
    copies = found.where("n_shingles > 0 and component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(common.stored(copies, "copies"), "doc_id", "left_anti")
    again = found.where("n_shingles > 0 and component_id = doc_id").groupBy("doc_id").count().where("count > 1")
    if again.limit(1).count():  # rows that share an id
        left = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(left.where("doc_id is null"))
    return left.select(*COLUMNS)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(surrogates.replace_pii(docs, key=surrogates.query_key(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("packing", packed),
]

#: The classifier, the join's shingle hashes, keyed surrogates and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs, last = common.table(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        mark, path = common.mark(), common.own(common.scratch_path(spark, f"stage-{name}"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.drop_since(spark, mark, docs)  # what the stage read lazily is in its table now
        if last:
            common.remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
