"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept; run() writes every stage's rows as Parquet and reads them again.
All but the last stage return the columns of documents; other columns are not read. A doc_id may be null or shared by rows with different texts: every row is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, lang_id, mixing, packing, toxicity
from .queries import tokenizer_path
from .staging import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: words of a shingle and similarity in percent.
SHINGLE, PERCENT = 5, 80
_OWN = 1 << 62


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of documents and id, a number of every row: its doc_id, or one of its own above all of these where that is null, negative or shared by rows.

    Rows without a doc_id of their own are written as a table, so that their numbers stay.
    """
    docs = docs.select(*COLUMNS)
    shared = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    odd = F.col("doc_id").isNull() | (F.col("doc_id") < 0) | (F.col("doc_id") >= _OWN)
    own = docs.where(odd).union(docs.where(~odd).join(shared, "doc_id", "left_semi").select(*COLUMNS))
    # Those with a doc_id come first.
    own = cut(own.withColumn("id", F.lit(_OWN) + F.when(F.col("doc_id").isNull(), _OWN >> 1).otherwise(0) + F.monotonically_increasing_id()))
    return docs.where(~odd).join(shared, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").alias("id")).union(own)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the model rejects: no letters, or too little confidence in any language. Without labelled rows only the former go."""
    model = lang_id.train(docs)
    out = lang_id.identify(docs, model, keep=COLUMNS[1:])
    return out.where("not rejected").select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity model predicts to be toxic; none where the labels have but one class."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model, keep=COLUMNS[1:])
    return out.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of documents that links of five-word shingles and a similarity of 0.8 hold together the one of least doc_id.

    Of copies under one doc_id, or under none, one is kept, and a document with a doc_id of its own before them. Texts without words are near nothing and stay.
    """
    docs = numbered(docs)
    groups = jaccard_join.join_components(docs.select(F.col("id").alias("doc_id"), "text"), PERCENT, SHINGLE)
    keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("id"))
    return docs.join(keep, "id", "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes its words, to the nearest whole number, three times at most.

    What the mix leaves out goes: documents of which it takes less than half their words, as their source has more than its share, and those without words, of which there is nothing to take.
    """
    docs = numbered(docs)
    taken = mixing.mix(docs.select(F.col("id").alias("doc_id"), "text", "source")).where("size > 0")
    copies = taken.select(F.col("doc_id").alias("id"), F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias("copies")).where("copies > 0")
    times = docs.join(copies, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack everything into sequences of token windows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]
#: Two stages learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; the stages' tables lie in the shared checkpoint folder until the application ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
