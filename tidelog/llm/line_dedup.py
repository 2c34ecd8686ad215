"""Line dedup: lines that many documents hold stay in one document only.

Method: hashes of line keys are range-partitioned and sorted by key, then document (largest first)
and position; the first occurrences stream by in that order, and what comes back per document is a
compressed bitmap of its lines, not text. Native: DataFrame functions only.

A key with more than a thousandth of all occurrences, or with over a million, is counted with map-side
combination instead, since sorting would put it into one task; the keepers of these keys are broadcast
where they are counted and few, and else joined. Both ways give the same answer.

Defined results. Null or empty text: one empty line. Null doc_id: a document below every other.
Rows with the same doc_id count as one document towards `min_docs`; each row gets its own bitmap by
its own text. Repeated rows: each comes back. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ASCII_SPACE, ascii_lower, few, hash128, hot_keys, row_key, workspace, written

WORD = 32


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2) of each long enough key with its document, the row's key and the line's position."""
    # the row's key comes before the lines, else its hashes of the whole text would be taken again for every line
    keyed = docs.select("doc_id", *row_key("doc_id", "text"), lines_of(F.col("text")).alias("lines"))
    rows = keyed.select("doc_id", "k1", "k2", F.posexplode("lines").alias("pos", "line"))
    keys = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    return keys.select(*hash128("key"), "doc_id", "k1", "k2", "pos")


def keep_bitmaps(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """k1, k2 (see row_key), words: array of (word, bits), sorted; a set bit is a line that goes.

    Words without a set bit are left out, and so are rows that lose no line."""
    spark = docs.sparkSession
    at = workspace(spark, "line_dedup")
    occ = written(occurrences(docs, min_chars), f"{at}/occurrences")
    hot = hot_keys(occ, f"{at}/hot")
    n_hot = hot.count()

    ordered = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    ranked = (
        occ.join(few(hot, n_hot), ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
        .withColumn("nth", F.dense_rank().over(ordered))
        .withColumn("n_docs", F.max("nth").over(Window.partitionBy("h1", "h2")))
    )
    cold_out = ranked.filter((F.col("nth") > 1) & (F.col("n_docs") >= min_docs))

    hot_occ = occ.join(few(hot, n_hot), ["h1", "h2"])
    keepers = written(
        hot_occ.select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.max("doc_id").alias("keeper"), F.count("*").alias("n_docs"))
        .filter(F.col("n_docs") >= min_docs),
        f"{at}/keepers",
    )
    hot_out = occ.join(few(keepers, n_hot), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))

    gone = cold_out.select("k1", "k2", "pos").unionByName(hot_out.select("k1", "k2", "pos"))
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    return (
        gone.repartition("k1", "k2")
        .groupBy("k1", "k2", F.expr(f"int(pos div {WORD})").alias("word")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text as the bitmaps say; the columns must not be there yet."""
    found = docs.select("*", *row_key("doc_id", "text")).join(bitmaps, ["k1", "k2"], "left").drop("k1", "k2")
    # each word's bits stand after as many empty words as lie between it and the one before
    dense = F.flatten(F.transform("words", lambda w, i: F.concat(
        F.array_repeat(F.lit(0).cast("long"), w["word"] - F.when(i > 0, F.col("words")[i - 1]["word"]).otherwise(F.lit(-1)) - 1), F.array(w["bits"])
    )))
    found = found.withColumn("words", dense).withColumn("lines", lines_of(F.col("text")))
    kept = F.expr(
        f"filter(lines, (line, i) -> shiftright(coalesce(get(words, int(i div {WORD})), 0L), i % {WORD}) % 2 = 0)"
    )
    found = found.withColumn("kept", F.when(F.col("words").isNull(), F.col("lines")).otherwise(kept))
    return (
        found.withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dropped", (F.size("lines") - F.size("kept")).cast("long"))
        .withColumn("kept_text", F.array_join("kept", "\n"))
        .drop("words", "lines", "kept")
    )


def line_dedup(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, kept_text for each row of docs."""
    slim = docs.select("doc_id", "text")
    return apply_bitmaps(slim, keep_bitmaps(slim, min_chars=min_chars, min_docs=min_docs))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos FROM s),
k AS (SELECT doc_id, pos, ls[pos] AS line, translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
