"""From documents to piece ids: language ID, near-duplicates, personal data, mixing, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents; further columns are dropped.  Rows are treated one
by one: a null or repeated id, a null language or source, and repeated rows are allowed in every stage, and an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gnomon.llm import langid, mixing, ngram_join, pieces, pii
from gnomon.llm.common import read_table, word_count
from gnomon.shipping import ship
from gnomon.storage import fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go, as do null texts and those without a letter; the others carry the language found."""
    model = langid.train(docs)
    found = langid.identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, the one of least id; rows without words or without id all stay."""
    return ngram_join.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with the personal data in its text replaced; a null text stays null."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row appears as often as the mix takes it, which may be never; rows without id, source or text are mixed as well."""
    # Rows of the same id (or none), source and size are equal to the mix: their copies are dealt out by text.
    same = lambda size: F.to_json(F.struct("doc_id", "source", size.alias("size"))).alias("_same")
    copies = mixing.pareto_mix(docs).filter("copies > 0").select(same(F.col("size")), "copies")
    copies = copies.groupBy("_same").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies"))
    place = F.row_number().over(Window.partitionBy("_same").orderBy("text", "lang"))
    d = docs.select(*COLUMNS, same(word_count(F.col("text")))).withColumn("_at", place - 1).join(copies, "_same")
    d = d.withColumn("_times", F.get("_copies", F.col("_at"))).filter(F.col("_times") > 0)
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids and their number; null ids for a null text, with a null number."""
    return pieces.encode(docs.select(*COLUMNS)).withColumn("n_pieces", F.size("piece_ids").cast("long"))


def shipped(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language ID", shipped(identify_language)),
    ("n-gram Jaccard join", shipped(drop_near_duplicates)),
    ("PII", shipped(redact_personal_data)),
    ("mixing sources to target weights", shipped(mix_sources)),
    ("SentencePiece encoding and decoding", shipped(encode_pieces)),
]

#: Language inference, the join and piece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
