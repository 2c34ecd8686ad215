"""The corpus pipeline: language ID, line dedup, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. Decisions:
 language_id      rows that the calibrated rejection turns away go, the others stay as they are;
 line_dedup       lines that it drops leave the text, n_chars follows; no document goes;
 near_duplicates  of each component of linked documents the one with the least doc_id stays (null last; of rows
                  that share it the one with the least hash of all columns); documents with an empty set stay;
                  rows that are equal in every column count as one;
 secret_scan      every span is replaced by a mark, n_chars follows; no document goes;
 packing          the pieces of the packed sequences.

Defined results. A text that is null, empty or without a letter goes with the first stage. Null doc_id, lang or source
and extra columns stay as they are, whatever their names; rows that share a doc_id are documents of their own.
An empty table passes through every stage. Very long texts are handled whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import jaccard, langid, line_dedup, packing, secret_scan
from tidelog.llm._shared import made, release, remove, row_key, shared_dir, spent_shuffles_go, written
from tidelog.llm.tokens import tokenizer_path


def _slim(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns, text and all others in one struct, so that no name clashes with an operator's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (*keys, "text")]
    return docs.select(*keys, "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("rest"))


def _full(slim: DataFrame, docs: DataFrame, text, *keys: str) -> DataFrame:
    """slim with docs' columns again; the new text's length goes into n_chars where there is such a column."""
    size = F.char_length("__text")
    new = {"text": F.col("__text"), **{k: F.col(k) for k in keys}}
    if "n_chars" in docs.columns:
        new["n_chars"] = size.cast(docs.schema["n_chars"].dataType)
    return slim.withColumn("__text", text).select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    return docs.filter(~langid.scorer(spark, models)(F.col("text"))["rejected"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.apply_bitmaps(_slim(docs, "doc_id"), line_dedup.keep_bitmaps(docs.select("doc_id", "text")))
    return _full(found, docs, F.when(F.col("text").isNotNull(), F.col("kept_text")), "doc_id")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = row_key(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    found = jaccard.jaccard_components(docs, key=(key[0], key[1]))
    leads = found.filter("leads").select("k1", "k2").distinct()
    # equal rows have equal keys: they meet before the shuffle, one stays
    row = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    one = row.groupBy("k1", "k2").agg(F.first("row").alias("row")).join(leads, ["k1", "k2"], "left_semi")
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = secret_scan.scan(docs.select("doc_id", "source", "text"))
    return _full(secret_scan.redact(_slim(docs, "doc_id", "source"), spans), docs, F.col("text"), "doc_id", "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("packing", packed),
]

#: Language models, shingle components and tokens are not expressed in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with spent_shuffles_go(spark):
        for name, stage in STAGES[:-1]:
            mark = made()
            done = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            docs = written(done, path)
            release(spark, mark)  # the stage's own tables, and what it has read
            if before:
                remove(spark, before)
            before = path
    return STAGES[-1][1](spark, docs, sf_dir)
