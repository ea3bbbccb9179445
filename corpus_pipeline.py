"""The corpus pipeline over ``documents``.

STAGES lists (name, function) in order.  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes it as Parquet to the shared folder and rereads it as
the next one's docs.  All but the last return the columns of documents:

1. toxicity: documents the trained machine scores 0.5 or more go;
2. jaccard_join: of each group of near duplicates the document with the smallest doc_id
   stays (rows that repeat a document are near duplicates of it);
3. suffix_dedup: bytes of 200-byte strings that start anywhere else too are removed;
4. packing: what is left is packed into sequences of 2048 tokens.

Edge cases follow the operators'.  Rows with a null doc_id can't be named as the copy of
another and stay, all of them, and link no others here; a doc_id that repeats with other
texts names one document per text, and of rows equal in both one stays.  A document whose
whole text repeats stays with an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import jaccard_join, packing, suffix_dedup, toxicity
from fleetlens.llm.common import materialise, table
from fleetlens.llm.queries import vocabulary
from fleetlens.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("toxic_score") < 0.5).drop("toxic_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").head(1):
        found = materialise(jaccard_join.shingle_components(docs), "near-copies")
        copies = found.where("component_id <> doc_id").select("doc_id")
        return docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    # a doc_id repeats: rows get a number of their own, in order of doc_id, so that the smallest of a group is still the first
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    keyed = named.select(F.col("doc_id").alias("own_id"), digest.alias("own_digest"), "text")
    one = materialise(keyed.groupBy("own_id", "own_digest").agg(F.first("text").alias("text")), "own-texts")
    pairs = materialise(one.select("own_id", "own_digest").orderBy("own_id", "own_digest").withColumn("own_key", F.monotonically_increasing_id()), "own-keys")
    found = jaccard_join.shingle_components(one.join(pairs, ["own_id", "own_digest"]).select(F.col("own_key").alias("doc_id"), "text"))
    firsts = found.where("component_id = doc_id").select(F.col("doc_id").alias("own_key"))
    kept = pairs.join(firsts, "own_key", "left_semi").select(F.struct(F.col("own_id"), F.col("own_digest")).alias("own_row"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("own_id"), digest.alias("own_digest"))).alias("own_row"))
    left = rows.where("own_row is not null").join(kept, "own_row", "left_semi").groupBy("own_row").agg(F.first("row").alias("row")).select("row.*")
    return left.unionByName(rows.where("own_row is null").select("row.*"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return suffix_dedup.without_repeats(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.best_fit_pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack_sequences),
]

#: A trained model, byte-string removal and tokenizing have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
