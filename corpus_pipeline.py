"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir); its operators are those of tallyfold.llm.

A stage's result is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents, with n_chars that of the text. Every stage judges by the row, also where ids are null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold import shared
from tallyfold.llm import common, decontamination, jaccard, langid, lines, tokenization

#: Documents go if no language is predicted, or with less than this probability.
LEAST_LANGUAGE_SCORE = 0.5


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model of operator 2 tells; the model is learnt from docs."""
    common.release(spark)
    model = langid.fit(docs.filter(~common.held_out("doc_id")), _tokenizer("piece_bpe_32k.model")[0])
    found = langid.predict(docs, model, carry=["text", "lang", "source", "n_chars"])
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).filter(F.col("score") >= LEAST_LANGUAGE_SCORE).select("doc_id", "text", "lang", "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    common.release(spark)
    out = lines.dedup_lines(docs, "source", out_cols=["doc_id", "lang", "source"], count_cols=False)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a stored key of their own: ids may be null or repeated."""
    return common.keep(docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text", "lang", "source", "n_chars"), "keyed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, the row of the least id (null ids last); of its rows of that id, one."""
    common.release(spark)
    rows = _keyed(docs)
    found = common.keep(jaccard.join(rows, "__row").select("__row", "component_id").join(rows.select("__row", "doc_id"), "__row"), "members")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    best = common.keep(best.select("component_id", F.col("best.__row").alias("stays")), "representatives")
    gone = common.keep(found.join(best, "component_id").filter("__row <> stays").select("__row"), "copies")
    common.release(spark, "keyed", "copies")  # the sets are no longer needed when whole texts are read again
    return common.without(rows, gone, "__row").select("doc_id", "text", "lang", "source", "n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no window of a benchmark item occurs."""
    common.release(spark)
    rows = _keyed(docs)
    found = decontamination.phrases(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    hit = common.keep(found.filter(F.size("hits") > 0).select("__row"), "hits")
    common.release(spark, "keyed", "hits")
    return common.without(rows, hit, "__row").select("doc_id", "text", "lang", "source", "n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    common.release(spark)
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken")
    back = tokenization.decode(tokenization.encode(docs, path, pattern), path, pattern)
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]

#: Language models, components and byte pair merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            shared.delete(before)
        docs, before = spark.read.parquet(path), path
    common.release(spark)
    return docs
