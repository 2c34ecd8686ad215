r"""Secret scans with corpus-wide ownership frequency. Native: DataFrame functions only.

Patterns give candidates with their spans; the candidates' hashes are then aggregated over the whole
corpus by distinct repositories and owners. A value that many owners or many repositories hold is a widely
copied example, one that few of both hold looks like a live credential. Base spans always stay; the frequencies
label them, and decide which opaque tokens (no keyword, but long and mixed) become spans as well.

`documents` has no repository: there a document stands for one, and its source is the owner.

Defined results. Null or empty text: no span. Null owner: one owner more. Repeated rows (same doc_id,
text and owner): counted once, each gets its spans. Rows with the same doc_id and other texts: each
gets its own. A span is the whole match, in code points, end exclusive. Empty table: no rows. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import few, hash128, hot_rows, row_key, workspace, written


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Kind, pattern, group whose text is the value, its least length.
BASE = (
    (
        "assign",
        "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
        + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # A greedy run that is too short leaves no longer one behind it, so the least length may stand in these two patterns.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: A long token of letters and digits; it counts as opaque if it has a digit, a capital and a small letter.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
KINDS = [k for k, *_ in (*BASE, OPAQUE)]
#: A value is live up to so many owners and so many repositories.
LIVE_OWNERS, LIVE_REPOS = 2, 20


def _matches(text: Column, pattern: str, group: int) -> Column:
    """array of (gap before the match, its length, its value), lengths in code points; null without a match."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    zipped = F.zip_with(
        whole,
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)),
        lambda m, gap: F.struct(
            F.char_length(gap).cast("long").alias("gap"),
            F.char_length(m).cast("long").alias("len"),
            (F.regexp_extract(m, pattern, group) if group else m).alias("value"),
        ),
    )
    return F.when(F.size(whole) > 0, zipped)


def candidates(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, owner, kind, start, end, value hash (h1, h2): one row for each distinct candidate of a row."""
    keyed = docs.select("doc_id", "owner", "text", *row_key("doc_id", "owner", "text"))
    kinds = F.array(*[
        F.struct(F.lit(n).alias("kind_no"), F.lit(least).alias("least"), _matches(F.col("text"), p, g).alias("found"))
        for n, (_, p, g, least) in enumerate((*BASE, OPAQUE))
    ])
    rows = (
        keyed.select("doc_id", "owner", "k1", "k2", F.explode(kinds).alias("x"))
        .select("doc_id", "owner", "k1", "k2", "x.kind_no", "x.least", F.posexplode("x.found").alias("nth", "m"))
        .select("doc_id", "owner", "k1", "k2", "kind_no", "least", "nth", "m.*")
        .repartition("k1", "k2")
        .dropDuplicates(["k1", "k2", "kind_no", "nth"])  # of repeated rows
    )
    before = Window.partitionBy("k1", "k2", "kind_no").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    good = (F.char_length("value") >= F.col("least")) & ((F.col("kind_no") < len(BASE)) | mixed)
    return placed.filter(good).select("k1", "k2", "doc_id", "owner", "kind_no", "start", "end", *hash128("value"))


def ownership(cands: DataFrame) -> DataFrame:
    """h1, h2, n_rows, n_repos, n_owners over the whole corpus; every step combines before it shuffles."""
    by_owner = (
        cands.groupBy("h1", "h2", "doc_id", "owner").agg(F.count("*").alias("n"))
        .groupBy("h1", "h2", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
    )
    return by_owner.groupBy("h1", "h2").agg(
        F.sum("n").alias("n_rows"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners")
    )


def scan(
    docs: DataFrame, *, repo_col: str = "doc_id", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS
) -> DataFrame:
    """k1, k2 (row_key of repo, owner, text), spans: array of (start, kind_no, end, live), sorted, for rows that have any.

    live: at most `live_owners` owners and `live_repos` repositories hold the value. Opaque tokens are spans only where live."""
    at = workspace(docs.sparkSession, "secret_scan")
    slim = docs.select(F.col(repo_col).alias("doc_id"), F.col(owner_col).alias("owner"), "text")
    cands = written(candidates(slim), f"{at}/candidates")
    total = cands.count()
    freq = written(ownership(cands), f"{at}/ownership")
    # values that very many candidates have are few: broadcast once counted; the others meet in a shuffle
    hot = freq.filter(F.col("n_rows") > hot_rows(total))
    n_hot = hot.count()
    of_hot = cands.join(few(hot, n_hot), ["h1", "h2"])
    of_cold = cands.join(few(hot.select("h1", "h2"), n_hot), ["h1", "h2"], "left_anti").join(freq, ["h1", "h2"])
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)
    judged = of_hot.unionByName(of_cold).withColumn("live", live)
    spans = judged.filter((F.col("kind_no") < len(BASE)) | F.col("live"))
    return spans.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "live"))).alias("spans")
    )


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind_no"] + 1)
    said = F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(said, ",")


def redact(docs: DataFrame, spans: DataFrame, *, repo_col: str = "doc_id", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); other columns stay as they are."""
    names = docs.columns
    found = docs.select("*", *row_key(repo_col, owner_col, "text")).join(spans, ["k1", "k2"], "left")
    # a span is dropped where an earlier one covers its start; then the text between spans is kept
    merged = F.expr("""
        aggregate(spans, named_struct('at', 0L, 'kept', cast(array() as array<struct<start:bigint,end:bigint>>)),
          (s, x) -> if(x.end <= s.at, s, named_struct('at', x.end, 'kept', array_append(s.kept, named_struct('start', greatest(x.start, s.at), 'end', x.end)))),
          s -> s.kept)""")
    found = found.withColumn("cuts", F.when(F.col("spans").isNotNull(), merged))
    mark_sql = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    text = F.expr(f"""
        concat(array_join(transform(cuts, (c, i) -> concat(
          substring(text, int(if(i = 0, 0L, cuts[i - 1].end)) + 1, int(c.start - if(i = 0, 0L, cuts[i - 1].end))),
          if(i > 0 and c.start = cuts[i - 1].end, '', {mark_sql}))), ''),
          substring(text, int(element_at(cuts, -1).end) + 1))""")
    found = found.withColumn("text", F.when(F.col("cuts").isNotNull(), text).otherwise(F.col("text")))
    return found.select(*names)


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = docs.select("doc_id", *row_key("doc_id", "source", "text")).join(scan(docs), ["k1", "k2"], "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,live:boolean>>)"))
    found = found.withColumn("spans", spans).withColumn("base", F.filter("spans", lambda x: x["kind_no"] < len(BASE)))
    n = lambda i: F.size(F.filter("base", lambda x: x["kind_no"] == i)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def _sql() -> str:
    parts = []
    for n, (_, p, g, least) in enumerate((*BASE, OPAQUE)):
        q = p.replace("'", "''")
        value = f"regexp_extract(m, '{q}', {g})" if g else "m"
        mixed = " AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')" if n == len(BASE) else ""
        parts.append(f"""SELECT doc_id, source, {n} AS kind_no, start, start + length(m) AS "end", value FROM (
          SELECT doc_id, source, m, {value} AS value,
            sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY nth) - length(m) AS start FROM (
            SELECT doc_id, source, ms[nth] AS m, gs[nth] AS gap, nth FROM (
              SELECT doc_id, source, ms, gs, unnest(range(1, len(ms) + 1)) AS nth FROM (
                SELECT doc_id, source, regexp_extract_all(text, '{q}') AS ms, string_split_regex(text, '{q}') AS gs FROM documents WHERE text IS NOT NULL)))
          ) WHERE length(value) >= {least}{mixed}""")
    name = "CASE kind_no " + " ".join(f"WHEN {n} THEN '{k}'" for n, k in enumerate(KINDS)) + " END"
    said = f"{name} || ':' || start::BIGINT || ':' || \"end\"::BIGINT"
    return f"""
WITH c AS ({' UNION ALL '.join(parts)}),
f AS (SELECT value, count(DISTINCT coalesce(source, chr(0))) <= {LIVE_OWNERS} AND count(DISTINCT doc_id) <= {LIVE_REPOS} AS live FROM c GROUP BY value),
s AS (SELECT c.*, f.live FROM c JOIN f USING (value) WHERE kind_no < {len(BASE)} OR f.live),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access,
  count(*) FILTER (WHERE kind_no = 2) AS n_hex, count(*) FILTER (WHERE live) AS n_live,
  string_agg({said}, ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < {len(BASE)}) AS base,
  string_agg({said}, ',' ORDER BY start, kind_no) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_live, 0) AS n_live, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
