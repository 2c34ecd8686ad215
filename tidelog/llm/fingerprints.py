r"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces. Native: DataFrame functions only.

A blank line ends a section, a newline a paragraph; a paragraph is hashed whole and, to locate edits
inside it, in pieces from its start (8 code points, then 32 each). A section's digest is the hash of
its paragraphs' digests, the root the hash of the sections' digests: equal roots mean equal texts, and
where roots differ, the branches that differ say where.

Fingerprint: `<root>` then for each section `/<digest>`, for each of its paragraphs `,<digest>.<pieces>`
(sha256 in hex; below the root the first 16 digits; a piece has 8 digits).
Likeness of two trees: distinct nodes that both have, over the distinct nodes of either. It is 1 only for equal roots.

Defined results. Null or empty text: one empty section with one empty paragraph, so equal to each other.
Order for `next`: descending doc_id; rows with the same doc_id share a place, for which the greatest
of their texts stands when another document looks at it. A null doc_id counts as the smallest id, -2^63.
A single document is its own next. Repeated rows: each comes back. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import workspace, written

PIECES = r"(?s)^.{1,8}|.{1,32}"


def _hex8(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with <prefix>fp (string) and <prefix>nodes (array of bigint) of column text (not null)."""

    def paragraph(p):
        pieces = F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.xxhash64(x))
        return F.struct(F.sha2(p, 256).alias("d"), pieces.alias("pieces"))

    def section(s):
        return F.transform(F.split(s, "\n", -1), paragraph)

    t = f"{prefix}tree"
    df = df.withColumn(t, F.transform(F.split(F.col(text), "\n\n", -1), section))
    df = df.withColumn(f"{prefix}secs", F.transform(t, lambda s: F.sha2(F.array_join(F.transform(s, lambda p: p["d"]), ""), 256)))
    df = df.withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}secs", ""), 256))
    said_p = lambda p: F.concat(F.lit(","), F.substring(p["d"], 1, 16), F.lit("."), F.array_join(F.transform(p["pieces"], _hex8), ""))
    said = F.array_join(
        F.zip_with(t, f"{prefix}secs", lambda s, d: F.concat(F.lit("/"), F.substring(d, 1, 16), F.array_join(F.transform(s, said_p), ""))), ""
    )
    paras = F.flatten(t)
    nodes = F.array_distinct(F.concat(
        F.flatten(F.transform(paras, lambda p: p["pieces"])),
        F.transform(paras, lambda p: F.xxhash64(p["d"], F.lit(1))),
        F.transform(f"{prefix}secs", lambda d: F.xxhash64(d, F.lit(2))),
        F.array(F.xxhash64(f"{prefix}root", F.lit(3))),
    ))
    return (
        df.withColumn(f"{prefix}fp", F.concat(f"{prefix}root", said))
        .withColumn(f"{prefix}nodes", nodes)
        .drop(t, f"{prefix}secs", f"{prefix}root")
    )


def likeness(a: str, b: str, fp_a: str, fp_b: str) -> Column:
    """Of two trees by their nodes; 1 exactly if the roots are equal, with which a fingerprint begins."""
    both = F.size(F.array_intersect(a, b))
    ratio = both.cast("double") / (F.size(a) + F.size(b) - both)
    return F.when(F.substring(fp_a, 1, 64) == F.substring(fp_b, 1, 64), F.lit(1.0)).otherwise(F.least(ratio, F.lit(0.999999)))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for each row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_tree(df, "text", "a_")
    return df.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.col("a_fp").alias("fingerprint"))


def _paragraphs(fp: Column) -> Column:
    """The digests of a fingerprint's paragraphs with their pieces, over all sections."""
    branches = F.slice(F.split(F.replace(fp, F.lit("/"), F.lit(",/")), ","), 2, 1 << 30)
    return F.filter(branches, lambda x: ~x.startswith("/"))


def _aligned(fp_a: Column, fp_b: Column) -> Column:
    """Array of one struct: the paragraphs' branches a and b of both, and how many of them agree at the head and at the tail."""
    same = F.substring(fp_a, 1, 64) == F.substring(fp_b, 1, 64)
    none = F.expr("cast(array() as array<string>)")
    trees = F.struct(F.when(same, none).otherwise(_paragraphs(fp_a)).alias("a"), F.when(same, none).otherwise(_paragraphs(fp_b)).alias("b"))

    def common(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        first = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p == q), False)
        return F.when(first > 0, first.cast("int") - 1).otherwise(n)

    def with_head(t):
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), common(t["a"], t["b"]).alias("head"))

    def with_tail(t):
        rest = lambda x: F.reverse(F.slice(x, t["head"] + 1, F.size(x) - t["head"]))
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), t["head"].alias("head"), common(rest(t["a"]), rest(t["b"])).alias("tail"))

    # each step's result is an element, so that it is computed once
    return F.transform(F.transform(F.array(trees), with_head), with_tail)


def edit_range(fp_a: Column, fp_b: Column) -> Column:
    """Where two trees differ: struct of a_from, a_to, b_from, b_to, ranges of paragraphs over all sections (from 0, ends exclusive).

    Equal roots: empty ranges at 0. Branches are aligned from both ends by their digests, so a paragraph put in or
    taken out moves no other; several edits are inside one range."""

    def ends(t):
        return F.struct(
            t["head"].alias("a_from"), (F.size(t["a"]) - t["tail"]).alias("a_to"), t["head"].alias("b_from"), (F.size(t["b"]) - t["tail"]).alias("b_to"),
        )

    return F.transform(_aligned(fp_a, fp_b), ends)[0]


def differing(fp_a: Column, fp_b: Column) -> Column:
    """Positions of a's paragraphs (over all sections, from 0) inside edit_range whose branch b's range lacks; empty if the roots agree.

    Compares the range's paragraphs with those that b lacks, which is quadratic for long texts without anything in common."""

    def only(t):
        inner = lambda x: F.slice(x, t["head"] + 1, F.size(x) - t["head"] - t["tail"])
        lone = F.array_except(inner(t["a"]), inner(t["b"]))
        marks = F.transform(F.array(F.struct(inner(t["a"]).alias("x"), lone.alias("lone"))), lambda s: F.transform(
            s["x"], lambda p, i: F.when(F.array_contains(s["lone"], p), t["head"] + i)
        ))
        return F.array_compact(marks[0])

    return F.transform(_aligned(fp_a, fp_b), only)[0]


def ring(ids: DataFrame, at: str) -> DataFrame:
    """ids (distinct k, n) with next_k in descending order, the first after the last.

    Range partitions hold neighbours; a table of one row per partition closes the gaps between them."""
    ordered = ids.repartitionByRange(F.col("k").desc())
    placed = written(ordered.select("k", "n", F.spark_partition_id().alias("part")), at)
    firsts = placed.groupBy("part").agg(F.max("k").alias("first"))
    after = firsts.select(
        "part",
        F.coalesce(
            F.lead("first").over(Window.orderBy(F.col("first").desc())), F.max("first").over(Window.partitionBy(F.lit(0)))
        ).alias("after"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("k").desc())
    pairs = placed.withColumn("next_k", F.lead("k").over(inside)).join(F.broadcast(after), "part")
    return pairs.select("k", "n", F.coalesce("next_k", "after").alias("next_k"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, that of its edited text (the second half replaced by the start of the
    next document), the likenesses and edited, the edit_range between both; edited_text is the last column.

    Texts are shuffled once by id; that exchange serves as the rows and as the texts which others look at."""
    at = workspace(docs.sparkSession, "fingerprints")
    rows = docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    ids = rows.select("k", F.char_length("text").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    looks = ring(ids, f"{at}/ring")

    dealt = rows.repartition("k")
    # doc_id rides along so that both uses of the exchange have the same columns, without which Spark shuffles twice
    greatest = F.max(F.struct("text", "doc_id")).alias("row")
    seen = dealt.groupBy("k").agg(greatest).select(F.col("k").alias("next_k"), F.col("row.text").alias("next_text"))
    given = with_tree(looks.join(seen, "next_k"), "next_text", "n_").select(
        "k", F.expr("left(next_text, n div 2)").alias("start"), F.substring("n_fp", 1, 64).alias("n_fp"), "n_nodes"
    )
    df = dealt.join(given, "k").withColumn("n", F.char_length("text"))
    df = df.withColumn("edited_text", F.expr("concat(left(text, n - n div 2), left(start, n div 2))"))
    df = with_tree(with_tree(df, "text", "a_"), "edited_text", "e_")
    return df.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.col("a_fp").alias("fingerprint"),
        F.col("e_fp").alias("edited_fingerprint"),
        likeness("a_nodes", "e_nodes", "a_fp", "e_fp").alias("near_edited"),
        likeness("a_nodes", "n_nodes", "a_fp", "n_fp").alias("near_next"),
        edit_range(F.col("a_fp"), F.col("e_fp")).alias("edited"),
        "edited_text",
    )


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.col("edited.a_from").alias("edit_from"), F.col("edited.a_to").alias("edit_to"),
    )
