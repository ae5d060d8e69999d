"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage gets all rows that its predecessor kept, as a table with the columns of ``documents``. Stages
that filter keep a row as it is or drop it; line dedup changes ``text`` and ``n_chars`` only. SQL can
express none of the first stages' models, so ORACLE_SQL is None and the tests compare run() with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.llm import decontaminate, langid, linededup, sentencepieces, simhash
from prospecta.llm.cluster import scratch

#: A language is accepted from this posterior probability on.
LEAST_SCORE = 0.5
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised: with a letter, a posterior of LEAST_SCORE or more and n-grams likely in that language.

    Null and empty texts go; rows are judged by their own text, so repeated rows stay or go together. Without labelled rows all go.
    """
    model, spread = langid.train_with_spread(docs)
    return langid.recognised(docs, model, LEAST_SCORE, spread)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove every line that matches an earlier line of the corpus; all documents stay.

    Null texts stay null. Rows equal in id and text are one document and keep the same lines; other rows of one id are documents of their own.
    """
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with a number that no column of ``docs`` has."""
    had = {c.lower() for c in docs.columns}
    return [next(f"{n}{k}" for k in range(1000) if f"{n}{k}" not in had) for n in names]


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one with the smallest id and, of several rows of that id, the smallest hash of the text.

    Rows equal in id and text are one document. Null and empty texts have one fingerprint and so are one component. Rows without an id come first. An empty table stays empty.
    """
    found = simhash.simhash_components(docs)
    own, text = _free(docs, "head_id", "head_text")
    heads = found.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("head"))
    heads = heads.select(F.col("head.id").alias(own), F.col("head.text_hash").alias(text))
    return docs.join(heads, docs.doc_id.eqNullSafe(F.col(own)) & (F.xxhash64(docs.text) == F.col(text)), "left_semi")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents with a region that a benchmark item contaminates.

    A row goes by its own text, whatever other rows share its id. Null and empty texts hold no region and stay.
    """
    [key] = _free(docs, "text_hash")
    texts = docs.select(F.xxhash64("text").alias("key"), "text")
    found = decontaminate.find_regions(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return docs.join(found.select(F.col("id").alias(key)).distinct(), F.xxhash64(docs.text) == F.col(key), "left_anti")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text: doc_id, ids, n_ids and whether they decode to the text. Null and empty texts have none; every row gives a row."""
    import public_tokenizers

    found = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "ids", F.size("ids").alias("n_ids"), "round_trip")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("uncontaminated", uncontaminated),
    ("pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each one's table is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
