"""A corpus pipeline: stages that each apply one operator of gridloom.llm to all that the stage before kept.

Every stage takes documents with columns doc_id, text, lang and source and any others, of any type and name, and all but
the last return the same columns. A table without rows gives one without rows. Long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, exact_dedup, langid, mixing, near_dedup
from gridloom.llm._common import fresh_dir, remove

VOCABULARY = "byte_bpe_50k.tiktoken"


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ..., which clash with nothing, and the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def digest(text: F.Column) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told, as they have no letter, go.

    Those are null and empty texts, and digits, marks and white space alone. Every other document stays, whatever its
    language: null ids, sources and languages and repeated rows don't matter. If no document has a language, any letter
    will do.
    """
    model = langid.fit(docs)
    if not model.languages:
        model = model._replace(languages=["any"])
    rows, names = numbered(docs)
    whole = rows.select(F.struct(*rows.columns).alias("row"), F.col(names["text"]).alias("text"))
    found = langid.predict(whole, model, id_col="row").filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.select("row.*").toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id stays: one row a text.

    A null text is an empty text. A null id is less than any other; of rows that repeat both id and text, one stays.
    """
    rows, names = numbered(docs)
    key = lambda doc_id, sha: F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha)
    kept = exact_dedup.exact_duplicates(docs).filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("key")).distinct()
    keyed = rows.withColumn("key", key(F.col(names["doc_id"]), digest(F.col(names["text"]))))
    # One id a text is left, so one row a key is one row a text: by the partitions that the join has made.
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key"]).select(*rows.columns).toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest doc_id (five-word shingles, similarity 0.8 or more).

    Documents without words are near nothing, so all stay. A null id is greater than any other, and rows that share an id
    are told apart by their texts; rows that repeat both stay or go together.
    """
    rows, names = numbered(docs)
    text, doc_id = F.col(names["text"]), F.col(names["doc_id"])
    keyed = rows.withColumn("key", F.struct(doc_id.isNull().alias("absent"), doc_id.alias("id"), digest(text).alias("sha")))
    kept = near_dedup.near_duplicates(keyed.select("key", text.alias("text")), id_col="key").filter("kept").select("key").distinct()
    return keyed.join(kept, "key", "left_semi").select(*rows.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them: twice, once, or not at all.

    A null source is a source; a document without words counts nothing and is taken as its place among its source's
    falls; repeated rows are taken each on its own.
    """
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of every document that was taken, digested: one row for each time it was taken.

    A null text is an empty text, of no tokens; null ids stay null.
    """
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("byte_bpe", encode)]

#: Language identification, MinHash and byte-pair encoding have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written as Parquet in the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = fresh_dir(spark, "pipeline")
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
            last = path
    return docs
