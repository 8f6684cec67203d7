"""From raw documents to token digests: classify, deduplicate, sanitise, mix, encode.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Counts and models of a stage are those of its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm.bpe import encode_texts
from terrafold.llm.jaccard_join import similar_classes
from terrafold.llm.mixing import mixed_texts
from terrafold.llm.pii import sanitise
from terrafold.llm.quality import classify
from terrafold.llm.shared import short_batches, stored, table

#: Ids that may go to every worker, some 30 MB.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as texts
    without words; rows with a null doc_id are scored like others; repeated rows stay or go alike. An
    empty table gives an empty table, and columns beyond COLUMNS are left out."""
    return classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles, the one with the
    smallest doc_id stays; documents without words are in no group. Of rows that repeat both a
    doc_id and its text one stays. Rows with a null doc_id all stay: nothing names them."""
    short_batches(spark)
    classes = stored(similar_classes(docs.select(F.col("doc_id").alias("id"), "text"), width=5, similarity=80), "classes")
    named = classes.where("id is not null").groupBy(F.col("id").alias("doc_id"))
    named = stored(named.agg(F.max(F.col("id") != F.col("component_id")).alias("gone"), F.count("*").alias("times")), "named")
    gone = named.where("gone").select("doc_id")
    if gone.count() <= BROADCAST_IDS:  # then the texts need not move; beyond it Spark merges by doc_id
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = named.where("not gone and times > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti")
    return once.select(*COLUMNS).union(kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and what discloses it replaced. A null text stays null, with 0
    characters; no row goes, and repeated rows get equal texts. An empty table gives an empty one."""
    short_batches(spark)
    clean = sanitise(docs.select(*COLUMNS))
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.coalesce(F.length("clean"), F.lit(0)).cast("bigint").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each whole pass over a document that the mix takes, and one for its parts. Null,
    empty and wordless texts hold nothing to take, so their rows go; a null source is a source; rows
    that repeat are rows of their own. An empty table gives an empty one."""
    short_batches(spark)
    taken = mixed_texts(docs.select(*COLUMNS))
    return taken.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null and empty texts have no tokens."""
    short_batches(spark)
    return encode_texts(docs.select("doc_id", "text"), texts=False)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier, the sanitiser's statistics and the encoder cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
