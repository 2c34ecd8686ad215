"""The operators against brute force, round trips and SQL; odd rows, empty tables, hot groups."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from rowform import normal
from pyspark.sql import functions as F

from tidelog.llm import _shared, bpe, chat_format, fingerprints, jaccard, langid, line_dedup, packing, queries, secret_scan, simple8b, token_io, tokens, topk
from tidelog.llm.components import components

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, duck, name):
    a, b = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


# --- 3 line dedup


def brute_lines(rows):
    held = collections.defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    least = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(least(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == least(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def lines_got(df):
    out = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    return sorted((tuple(r) for r in out), key=str)


def test_line_dedup_odd_rows(odd_docs, no_docs):
    assert lines_got(odd_docs) == brute_lines([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert lines_got(no_docs) == []


def test_line_dedup_hot_lines(spark):
    rows = [(i, f"a line that every document has got\nown line number {i} of this document\n" + "a second line that is common too" * (i % 2)) for i in range(400)]
    assert lines_got(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_lines(rows)


def test_line_dedup_many_lines(spark):
    """Three equal documents of very many lines: the work is linear in them."""
    import time

    n = 100_000
    text = "\n".join(f"a line of this very document {j}" for j in range(n))
    began = time.time()
    got = line_dedup.line_dedup(spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")).select("doc_id", "n_dropped", F.md5("kept_text").alias("m")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(0, n), (1, n), (2, 0)] and time.time() - began < 60
    assert {r.doc_id: r.m for r in got}[2] == hashlib.md5(text.encode()).hexdigest()


# --- 2 fingerprints


def check_fingerprints(df):
    got = collections.defaultdict(list)
    for r in fingerprints.edited_fingerprints(df).collect():
        got[r.doc_id].append(r)
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    top = {}
    for d, t in rows:
        k = -(1 << 63) if d is None else d
        top[k] = max(top.get(k, t), t, key=lambda x: x.encode())
    ring = sorted(top, reverse=True)
    after = {k: top[ring[(i + 1) % len(ring)]] for i, k in enumerate(ring)}
    want = collections.Counter()
    for d, t in rows:
        nxt = after[-(1 << 63) if d is None else d]
        want[(d, len(t), t[: len(t) - len(t) // 2] + nxt[: len(t) // 2])] += 1
    assert want == collections.Counter((d, r.n_chars, r.edited_text) for d, rs in got.items() for r in rs)
    by_text = collections.defaultdict(set)
    for d, rs in got.items():
        for r in rs:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            by_text[r.edited_text].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)


def test_fingerprints(odd_docs, no_docs, docs):
    check_fingerprints(odd_docs)
    check_fingerprints(docs)
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_fingerprints_tell_edits(spark, docs):
    rows = fingerprints.edited_fingerprints(docs).filter("n_chars > 60").select("near_edited", "near_next").collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.98 * len(rows)
    two = spark.createDataFrame([("a\nb\nc\n\nd\ne", "a\nB\nc\n\nd\ne!"), ("x", "x")], "a string, b string")
    for c in "ab":
        two = fingerprints.with_tree(two, c, f"{c}_")
    assert [r[0] for r in two.select(fingerprints.differing(F.col("a_fp"), F.col("b_fp"))).collect()] == [[1, 4], []]


def test_fingerprints_align_branches(spark):
    pairs = [("a\nb\nc", "a\nX\nb\nc"), ("a\nb\nc", "a\nc"), ("p", "q\n\nr"), ("same", "same"), ("a\na\nb", "a\nb"), ("", "z")]
    two = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for c in "ab":
        two = fingerprints.with_tree(two, c, f"{c}_")
    a, b = F.col("a_fp"), F.col("b_fp")
    got = two.orderBy("i").select(fingerprints.differing(a, b).alias("a"), fingerprints.differing(b, a).alias("b"), fingerprints.edit_range(a, b).alias("r")).collect()
    assert [(r.a, r.b) for r in got] == [([], [1]), ([1], []), ([0], [0, 1]), ([], []), ([1], []), ([0], [0])]
    for (x, y), r in zip(pairs, got, strict=True):
        x, y = x.split("\n"), y.split("\n")
        if "" not in x + y:
            assert x[: r.r.a_from] == y[: r.r.b_from] and (x == y or x[r.r.a_to :] == y[r.r.b_to :])


def test_single_document(spark):
    r = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")).collect()
    assert [(x.edited_text, x.near_next) for x in r] == [("abcabc", 1.0)]


# --- 8 chat formatting


def test_chat_round_trip(spark):
    nasty = ["\\", "\\0", "###", "####", "</turn>", "\\### Assistant: </turn> ok", "</turn", "a\n### b: c</turn>\n", "", None, "\\1\\2", "é😀"]
    rows = [(c, t, ["user", "assistant", "system", None, "a: b"][(c + t) % 5], nasty[(c * 7 + t) % len(nasty)], "x") for c in range(12) for t in range(9)]
    rows += [(50, 0, "user", "only a question", "x"), (None, None, "assistant", "no ids", "x"), (51, 1, "assistant", "tie", "x"), (51, 1, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in turns]
        assert list(back[c].loss) == [x[2] for x in turns if x[1] == "assistant"]
        for e in back[c].examples:
            assert back[c].formatted[: e.context_chars].count("</turn>\n") == e.turn_index
    ex = chat_format.examples(chat_format.format_conversations(df)).collect()
    assert len(ex) == sum(x[1] == "assistant" for v in by.values() for x in v)
    assert all(e.prompt.endswith("### assistant: ") for e in ex)
    assert chat_format.format_conversations(df.filter("false")).count() == 0


def test_loss_is_read_through_the_mask(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "one ### two"), (1, 2, "assistant", "é\\ three")]
    formatted = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    loss = lambda df: chat_format.read_back(df).collect()[0].loss
    assert loss(formatted) == ["one ### two", "é\\ three"]

    def moved(**by):
        fields = ("turn_index", "context_chars", "loss_start", "loss_chars")
        return formatted.withColumn("examples", F.transform("examples", lambda e: F.struct(*[(e[f] + by.get(f, 0)).cast("int" if f == "turn_index" else "bigint").alias(f) for f in fields])))

    assert loss(moved(loss_start=1, loss_chars=-1)) == ["ne ### two", "\\ three"]
    for wrong in ({"context_chars": 1}, {"loss_start": -40}, {"loss_chars": 40}, {"turn_index": 7}):
        with pytest.raises(Exception, match="mask does not fit"):
            loss(moved(**wrong))


def test_long_conversation(spark):
    import time

    turns = spark.range(40_000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("reply é </turn> "), F.col("id").cast("string")).alias("text"),
    )
    began = time.time()
    parsed = chat_format.parse(chat_format.format_conversations(turns)).select("conv_id", "examples", "pieces", "starts")
    [r] = chat_format.losses(parsed).collect()
    assert list(r.loss) == [f"reply é </turn> {i}" for i in range(1, 40_000, 2)] and time.time() - began < 60


def test_running_sums(spark):
    sizes = [[], [5], list(range(700)), [0] * 256, [3] * 257]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(sizes)], "i int, x array<bigint>")
    for r in df.select("i", chat_format.running_sums(F.col("x")).alias("s")).collect():
        assert r.s == [sum(sizes[r.i][:k]) for k in range(len(sizes[r.i]))]


# --- 6 secrets


def brute_spans(text):
    """Base spans by scanning as the contract says."""
    kinds = (
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_secret_spans(odd_docs, no_docs):
    spans = secret_scan.scan(odd_docs)
    keyed = odd_docs.select("doc_id", "text", *secret_scan.row_key("doc_id", "source", "text")).join(spans, ["k1", "k2"], "left")
    base = F.filter("spans", lambda x: x["kind_no"] < 3)
    n = 0
    for r in keyed.select("text", F.coalesce(secret_scan._joined(base), F.lit("")).alias("got")).collect():
        assert r.got == brute_spans(r.text)
        n += r.got != ""
    assert n >= 4
    assert secret_scan.scan(no_docs).count() == 0


def test_secret_ownership_and_redaction(spark):
    live = "Q7xLm2Rz9PvT4nBw8KsY6dGh"
    rows = [(i, f"id {i} password={'copied00example1'} end", f"s{i}", 0) for i in range(90)]
    rows += [(100, f"here is {live} now", "s0", 0), (101, "password=abcdefghijkl token=abcdefghijkl", "s1", 0), (102, "nothing here", None, 0), (103, None, None, None)]
    rows += [(200 + i, "shared zzz9ABCDEFGHIJKLMNOPQRSTUVWX", f"s{i}", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, spans int")
    out = {r.doc_id: r.text for r in secret_scan.redact(df.select("doc_id", "text", "source"), secret_scan.scan(df)).collect()}
    assert out[100] == "here is [SECRET] now" and out[101] == "[SECRET] [SECRET]" and out[102] == "nothing here" and out[103] is None
    assert out[3] == "id 3 [SECRET] end" and out[201] == rows[-4][1]
    flags = secret_scan.scan(df).select(F.explode("spans").alias("s")).select("s.kind_no", "s.live").collect()
    assert sum(not f.live for f in flags) == 90


def test_secret_in_many_repositories_of_one_owner(spark):
    """Copied through many repositories, a value is no live credential, however few own them."""
    rows = [(i, "key Q7xLm2Rz9PvT4nBw8KsY6dGh and password=abcdefghijkl", "s0") for i in range(30)] + [(100 + i, "key Z7xLm2Rz9PvT4nBw8KsY6dGh", "s0") for i in range(20)]
    spans = secret_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    found = collections.Counter((s.kind_no, s.live) for r in spans for s in r.spans)
    assert found == {(0, False): 30, (3, True): 20}


# --- tokens, 4, 5, 10


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def random_texts(n=400, seed=1):
    r = random.Random(seed)
    letters = "ab 'sS\nt  éÉ中1<|\t .>\xa0\x85ßÿ😀"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["<|endoftext|> x<|ENDOFTEXT|>", "we'LL don'T\n\n  x ", "aaaa" * 50]


def test_chunked_encoders_equal_the_library(docs):
    texts = random_texts() + [r.text for r in docs.limit(40).collect()]
    words, (model, byte) = tokens.library_encoder(WORD), bpe.model(BYTE)
    for encoder, path in ((words, WORD), (byte, BYTE)):
        lib = library(path)
        for lo, hi, ids, o in encoder(pa.array([*texts, None])):
            for j in range(lo, min(hi, len(texts))):
                assert lib.encode(texts[j], add_special_tokens=False).ids == ids[o[j - lo] : o[j - lo + 1]].tolist(), repr(texts[j])
    lib = library(BYTE)
    r = np.random.default_rng(0)
    for _ in range(50):  # ids that do not decode to valid text
        ids = r.integers(0, 50257, 20).astype(np.uint32)
        assert bpe._valid(model.text_bytes(ids, np.array([0, 20]))[0]).decode() == lib.decode(ids.tolist(), skip_special_tokens=False)


def test_segment_tree_takes_the_leftmost_lowest_pair():
    model = bpe.model(BYTE)[0]
    r = random.Random(2)
    ranks = {tuple(map(int, divmod(int(k), 1 << 32))): (int(rank), int(model._merged[rank])) for k, rank in zip(model._keys, model._ranks)}

    def plain(data):
        s = [int(model.byte_ids[b]) for b in data]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), key=lambda x: (x[0][0], x[1]), default=None)
            if best is None:
                return s
            s[best[1] : best[1] + 2] = [best[0][1]]

    words = [bytes(r.choice(b"abcdefgh the") for _ in range(r.randint(1, 40))) for _ in range(300)] + [b"a", b"", b"aaaaaaaaaaaaaaaaa"]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.words(words)] == [plain(w) for w in words]


def test_bpe_query(spark, docs, odd_docs, no_docs):
    lib = library(BYTE)
    for df in (docs, odd_docs):
        want = collections.Counter()
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            text = lib.decode(ids, skip_special_tokens=False)
            want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert want == collections.Counter(tuple(r) for r in bpe.encode_decode_digests(df, tokenizer=BYTE).collect())
    assert bpe.encode_decode(no_docs, tokenizer=BYTE).count() == 0
    r = bpe.encode_decode(odd_docs.filter("doc_id = 3"), tokenizer=BYTE).collect()
    assert {x.decoded for x in r} == {"Von.", "another text with the same id as one before"}


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("top", [2, 200, 50_000, 1 << 32, 1 << 63])
def test_simple8b_round_trip(n, top):
    ids = (np.random.default_rng(n).random(n) ** 3 * top).astype(np.uint64)
    words, offsets, at, escaped = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, n, at, escaped) == ids).all()
    assert len(at) == int((ids >= 1 << 60).sum())
    if n == 4000 and top == 2:
        assert len(words) < n / 50


def check_token_files(spark, df, path):
    lib = library(WORD)
    token_io.write_ids(df, path, tokenizer=WORD, end_id=1)
    got = sorted(map(tuple, token_io.read_digests(spark, path).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for d, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files(spark, docs, odd_docs, no_docs, tmp_path):
    check_token_files(spark, docs, f"file://{tmp_path}/a")
    check_token_files(spark, odd_docs, f"file://{tmp_path}/b")
    check_token_files(spark, no_docs, f"file://{tmp_path}/c")


def check_packing(df):
    lib = library(WORD)
    got = packing.pack(df, tokenizer=WORD, end_id=2).collect()
    by_seq, pieces = collections.defaultdict(list), collections.Counter()
    for r in got:
        by_seq[r.sequence_id].append(r)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 or at & (at - 1) == 0
    docs_, want = collections.defaultdict(list), collections.Counter()
    for r in df.select("doc_id", "text").collect():
        docs_[r.doc_id].append(np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4"))
    for d, ids in docs_.items():
        want[d] = sum(map(len, ids))
    for r in got:
        pieces[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in docs_[r.doc_id])
    assert pieces == want


def test_packing(docs, odd_docs, no_docs):
    check_packing(docs)
    check_packing(odd_docs)
    assert packing.pack(no_docs, tokenizer=WORD).count() == 0


def test_hilbert_curve_is_continuous():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


# --- 9 top-k


def brute_topk(rows, k=5):
    import math

    vec = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vec:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vec if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return sorted(out)


def test_topk_odd_rows(spark):
    r = random.Random(3)
    v = lambda n=6: [r.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, v()) for i in range(300)] + [(400 + i, [0.5] * 6) for i in range(80)] + [(None, v()), (900, None), (950, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (901, [float("nan")] * 6), (902, [float("inf")] * 6), (903, v(3)), (1000, v(3)), (1050, [])]
    rows += [rows[7], rows[50]]
    df = spark.createDataFrame([(i, x, 1, "a") for i, x in rows], "vec_id bigint, embedding array<float>, score int, rank string")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    distinct = list({(i, tuple(x) if x is not None else None): (i, x) for i, x in rows if x is None or not any(y != y for y in x if y is not None)}.values())
    assert got == brute_topk(distinct)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_components(spark):
    rows = [(0, [2.0]), (1, [1.0]), (2, [16777216.0]), (50, [2.0**40]), (3, [-(2.0**30)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df.filter("vec_id < 50"), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_topk([r for r in rows if r[0] < 50])
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") % 50 == 0).collect()


# --- 7 Jaccard


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(f"[{SPACE}]+", lower(t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def components_got(df):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_jaccard_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert components_got(odd_docs) == brute_components(rows)
    assert components_got(no_docs) == []


def test_jaccard_hot_groups(spark, monkeypatch):
    """A large group of near copies, not all linked to each other, and a passage that many documents share, with short columns and small blocks."""
    monkeypatch.setattr(jaccard, "COLUMN", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    for i in range(40):
        rows.append((100 + i, " ".join([*passage, *[f"x{i}_{j}" for j in range(r.randint(2, 40))]])))
    for i in range(30):
        rows.append((200 + i, " ".join(passage[: 25 + i % 6])))
    rows += [(300 + i, "exactly the same words in each of these") for i in range(60)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert components_got(df) == brute_components(rows)


def test_jaccard_link_counts(spark, monkeypatch):
    """Links inside a large group of near copies that are not all linked to each other, copies, short, empty and null texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(5)
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, "x y"), (4, "x y"), (5, "x z")]
    for i in range(70):
        w = [f"b{k}" for k in range(120)]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
        rows += [(100 + i, " ".join(w))] * (1 + i % 3)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))) for w in ((t or "").split() for _, t in rows)]
    linked = [[bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    want = sorted(((d, sum(row) - bool(a)) for (d, _), a, row in zip(rows, sets, linked, strict=True)), key=str)
    big = [sum(row) for row in linked[7:]]
    assert min(big) < max(big) < len(rows) - 7
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(((x.doc_id, x.n_links) for x in jaccard.jaccard_components(df, links=True).collect()), key=str) == want


def test_jaccard_leaves_no_shuffle_files(spark, docs):
    """Disk: shuffle files go with their query, tables with the operator; the settings are put back."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    mark = _shared.made()
    jaccard.jaccard_components(docs)
    for _ in range(20):  # they are deleted in the background
        left = {f for f in files() - before if f.startswith("shuffle")}
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == was
    assert [os.path.exists(p) for p in _shared._MADE[mark:]] == [False, True]
    _shared.release(spark, mark)


def test_jaccard_in_parts(spark, monkeypatch):
    """Pairs whose sets take more than the table of sets are verified in parts, with the same links."""
    monkeypatch.setattr(jaccard, "LEAST_PART", 1)
    monkeypatch.setattr(jaccard, "stored_bytes", lambda spark, path: 9000)
    counts, parts = [], jaccard._parts

    def counting(pairs, coded_bytes):
        counts.append(parts(pairs, coded_bytes))
        return counts[-1]

    monkeypatch.setattr(jaccard, "_parts", counting)
    r = random.Random(6)
    rows = []
    for i in range(90):
        w = [f"b{i % 9}_{k}" for k in range(60)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert components_got(df) == brute_components(rows)
    assert max(counts) > 2


def test_parts_follow_the_sets(spark):
    pairs = spark.createDataFrame([(1, 2, 100, 90), (1, 3, 100, 110), (4, 2, 95, 90)], "x bigint, y bigint, nx bigint, ny bigint")
    moved = 6 * (3 * 100 + 2 * 95 + 2 * 90 + 2 * 110)  # x once and for each pair, each y twice
    for limit, n in ((moved, 1), (moved - 1, 2), (moved // 5, 6 if moved % 5 else 5)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(jaccard, "LEAST_PART", 1)
            assert jaccard._parts(pairs, limit) == n
    assert jaccard._parts(pairs, 1) == 1 and jaccard._parts(pairs.filter("x < 0"), 0) == 1


def test_lean_workers(monkeypatch):
    """What other operators remember goes before the first batch; freed memory goes back at both ends, also of work cut short."""
    calls = []
    monkeypatch.setattr(_shared, "give_back", lambda: calls.append("back"))
    other = _shared.worker_cache()
    other["kept"] = 1
    work = _shared.lean(lambda batches: (b + 1 for b in batches))
    assert list(work(iter([1, 2]))) == [2, 3] and not other and calls == ["back", "back"]
    cut = work(iter([1, 2]))
    assert next(cut) == 2
    cut.close()
    assert calls == ["back"] * 4
    _shared._CACHES.remove(other)


def test_lean_workers_keep_their_own():
    """A worker's own cache stays where it is named, others' go."""
    other = _shared.worker_cache()
    mine = tokens.library_cache()
    mine["kept"] = other["kept"] = 1
    assert list(_shared.lean(lambda batches: batches, tokens.library_cache)(iter([1]))) == [1] and not other and mine.pop("kept")
    _shared._CACHES.remove(other)


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory is read as Linux tells it")
@pytest.mark.parametrize(("work", "most", "stays"), [("count", 270, 50), ("score", 300, 60)])
def test_language_workers_give_memory_back(work, most, stays):
    """Many different words in one process as a worker has them: the peak above what was there, and what stays, in MB."""
    script = """
import random, re, sys, threading, time
import numpy as np
import pyarrow as pa
from tidelog.llm import _shared, langid
work, most, stays = sys.argv[1], int(sys.argv[2]), int(sys.argv[3])
now = lambda: int(re.search(r"Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
r = random.Random(1)
texts = pa.array([" ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(100)) for _ in range(8000)])
rows = (pa.RecordBatch.from_arrays([pa.array(["en"] * len(x)), x], ["lang", "text"]) for x in (texts.slice(at, 1000) for at in range(0, len(texts), 1000)))
tables = [langid.Table(g, np.full(len(g), 0.5)) for g in langid._grams(["abc"])[0]]
class Given:
    value = langid.Models({lang: langid.KneserNey(tables, [None, *tables[1:]], 9, 0.5) for lang in ("a", "b", "c", "d")})
class Spark:
    class sparkContext:
        broadcast = staticmethod(lambda models: Given)
if work == "count":
    run, given = _shared.lean(langid._counter), rows
else:
    langid.F.arrow_udf = lambda f, schema: f
    run, given = langid.scorer(Spark, Given.value), iter([texts])
_shared.give_back()
before, peak, over = now(), [0], []
def watch():
    while not over:
        peak[0] = max(peak[0], now())
        time.sleep(0.01)
t = threading.Thread(target=watch)
t.start()
for x in run(given):
    del x
over.append(1)
t.join()
print("FOUND", work, round(peak[0] - before), round(now() - before))
assert peak[0] - before < most and now() - before < stays
"""
    found = subprocess.run([sys.executable, "-c", script, work, str(most), str(stays)], capture_output=True, text=True, timeout=200)
    assert found.returncode == 0, found.stdout + found.stderr


def test_grams_are_counted_in_blocks(monkeypatch):
    """Blocks of any size give the counts of all words at once."""
    r = random.Random(1)
    words = {"".join(r.choices("abc", k=r.randint(1, 6))): r.randint(1, 9) for _ in range(300)}
    found = []
    for size in (1, 7, 1 << 14):
        monkeypatch.setattr(langid, "BLOCK", size)
        keys, n = langid._counted(words)
        found.append((keys.tolist(), n.tolist()))
    keys, word = langid._gram_keys(list(words))
    brute = collections.Counter()
    for k, w in zip(map(tuple, keys.tolist()), word.tolist(), strict=True):
        brute[k] += list(words.values())[w]
    assert found[0] == found[1] == found[2] and dict(zip(map(tuple, found[0][0]), found[0][1], strict=True)) == brute


def test_labelled_text_without_letters(spark):
    """A task whose texts of a language have no letter has nothing to count."""
    rows = spark.createDataFrame([("en", "some words to learn from"), ("de", " 12 ")], "lang string, text string").repartition(1)
    assert langid.train(rows, F.lit(True)).names == ["en"]


def test_language_tables_come_in_few_files(spark, docs, monkeypatch):
    """Small tables have as many files as there are cores, whatever the shuffle partitions; all grams and languages stay."""
    seen, write = {}, langid.written

    def written(df, path):
        out = write(df, path)
        seen[path.rsplit("/", 1)[1]] = len(out.inputFiles())
        return out

    def tables():
        models = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True))
        return {(x, i): (t.hashes.tolist(), t.values[0].tolist()) for x, m in zip(models.names, models.models, strict=True) for i, t in enumerate([*m.grams, *m.contexts[1:]])}

    want = tables()
    name, coalesced = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(name)
    monkeypatch.setattr(langid, "written", written)
    spark.conf.set(name, "31")
    spark.conf.set(coalesced, "false")
    try:
        got = tables()
    finally:
        spark.conf.set(name, was)
        spark.conf.unset(coalesced)
    assert set(seen) == {"counts", "grams", "discounts", "contexts", "tables"}
    assert max(seen.values()) <= spark.sparkContext.defaultParallelism and got == want


def test_parts_follow_the_bytes(spark):
    """One partition for each core at least, more with the bytes; without an estimate coalesce() changes nothing."""
    cores = spark.sparkContext.defaultParallelism
    assert _shared.parts(spark, 0) == cores and _shared.parts(spark, 100 * _shared.PART_BYTES) == 101
    rows = spark.range(0, 70, 1, 7)
    assert _shared.planned_bytes(rows) == 560
    assert rows.coalesce(_shared.parts(spark, _shared.planned_bytes(rows))).rdd.getNumPartitions() == cores
    unknown = spark.createDataFrame(rows.rdd, "id bigint")
    assert unknown.coalesce(_shared.parts(spark, _shared.planned_bytes(unknown))).rdd.getNumPartitions() == 7


def test_packing_takes_small_batches(spark, docs, monkeypatch):
    """Whole texts go to the workers a few thousand at a time; the setting is put back."""
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.written
    was = spark.conf.get(name)
    monkeypatch.setattr(packing, "written", lambda df, at: (seen.append(spark.conf.get(name)), write(df, at))[1])
    packing.pack(docs.limit(5), tokenizer=WORD)
    assert seen == [str(packing.BATCH)] and packing.BATCH < int(was) and spark.conf.get(name) == was


def test_shared_rows_over_batches():
    """Columns of any length, over any batches, with repeated rows."""
    r = random.Random(1)
    for _ in range(300):
        rows = sorted((r.randint(0, 6), r.randint(0, 4), 9) for _ in range(r.randint(1, 30)))
        cuts = sorted(r.randint(0, len(rows)) for _ in range(r.randint(0, 6)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in p], pa.int64()) for i in range(3)], ["t", "node", "n"]) for p in parts]
        got = [tuple(x.values()) for b in jaccard._shared_rows(iter(batches)) for x in b.to_pylist()]
        held = collections.Counter(t for t, _, _ in set(rows))
        assert sorted(got) == sorted(x for x in set(rows) if held[x[0]] > 1 or x[0] in (rows[0][0], rows[-1][0]))


def test_word_hashes_in_parts(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abc  \n\tZ") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", "x" * 300, "  ", "y"]
    raw, o = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    h, wo = jaccard.Shingler()._part_hashes(raw, o)
    for part in (7, 50, 333):
        monkeypatch.setattr(jaccard, "PART", part)
        got, at = jaccard.Shingler()._word_hashes(raw, o)
        assert (got == h).all() and (at == wo).all()


def test_sets_by_semi_join(spark, odd_docs, monkeypatch):
    """More nodes than the bitmap serves: the table of nodes chooses the sets."""
    monkeypatch.setattr(jaccard, "NODE_BITS", 1)
    monkeypatch.setattr(jaccard, "MOST_NODE_BITS", 3)
    assert components_got(odd_docs) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_unfinished_components_are_an_error(spark, tmp_path):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "x bigint, y bigint")
    with pytest.raises(RuntimeError, match="not settled"):
        components(chain, f"file://{tmp_path}", rounds=2)


def test_components(spark, tmp_path):
    r = random.Random(1)
    links = [(r.randint(-50, 50), r.randint(-50, 50)) for _ in range(60)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "x bigint, y bigint"), f"file://{tmp_path}").collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


# --- 1 language ID


def test_language_accuracy(spark, sf):
    held = langid.op1_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and not r.rejected for r in held)


def test_held_out_is_crc_of_the_text(spark):
    rows = spark.range(40).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_models_are_distributions(spark, docs):
    m = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True)).models[0]
    seen = {int(h) for h in m.grams[0].hashes}
    letters = [c for c in [2, *range(32, 1000)] if int(langid.KneserNey._hash(np.array([[c]]))[0]) in seen]
    for context in ([1, 1, ord("t")], [1, 1, ord("q")], [ord("z")] * 3, [ord("t"), ord("h"), ord("e")]):
        lines = np.array([[*context, c] for c in letters])
        total = (2.0 ** -m.costs(*m._all(lines))).sum() + m.rest / m.letters * _weight(m, context)
        assert abs(total - 1) < 1e-3
    assert all((t.hashes[1:] >= t.hashes[:-1]).all() for t in m.grams)


def _weight(m, context):
    """Share of an unseen character that the orders above hand down in this context."""
    w = 1.0
    for k in range(1, langid.ORDER):
        at, there = m.contexts[k].find(langid.KneserNey._hash(np.array([context[langid.ORDER - 1 - k :]])))
        w *= float(m.contexts[k].values[0][at[0]]) if there[0] else 1.0
    return w


def test_language_odd_rows(odd_docs, no_docs):
    models = langid.train(odd_docs.select("doc_id", "text", "lang"), ~langid.held_out(F.col("doc_id")))
    got = langid.predict(odd_docs, models, odd_docs.columns).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert r["__lang"] == "und" and r["__score"] == 0 and r["__rejected"]
        else:
            assert r["__lang"] in ("en", "de")
    none = langid.train(no_docs.select("doc_id", "text", "lang"), F.lit(True))
    assert {r["__lang"] for r in langid.predict(odd_docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(no_docs, models, ["doc_id"]).count() == 0


def test_language_columns_of_the_same_names(spark, docs):
    models = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    df = docs.limit(5).select("doc_id", "text", F.lit("x").alias("__lang"), F.lit(3).alias("found"), F.lit(1).alias("odd.name"))
    got = langid.predict(df, models, df.columns)
    assert sorted(got.columns) == sorted([*df.columns, "__score", "__rejected"]) and got.filter("`__lang` = 'x'").count() == 0


def test_language_rejects_junk(docs):
    models = langid.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    junk = " ".join("".join(random.Random(i).choice("qxzjkvw") for _ in range(9)) for i in range(40))
    [(_, _, names, scores, rejected)] = list(models.predict(pa.array([junk, "", "12 34"])))
    assert list(rejected) == [True] * 3 and names[1:] == ["und"] * 2


def brute_kneser_ney(texts):
    """Share of each gram of the whole text by its characters, by length."""
    level = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            line = "\1\1\1" + w + "\2"
            level.update(line[i : i + 4] for i in range(len(line) - 3))
    out, top = {}, level
    for k in (4, 3, 2, 1):
        total, ones, twos = collections.Counter(), sum(n == 1 for n in level.values()), sum(n == 2 for n in level.values())
        for g, n in level.items():
            total[g[:-1]] += n
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
        out[k] = {g: (n - d) / total[g[:-1]] for g, n in level.items()}
        level = collections.Counter(g[1:] for g in level)
    return top, out


@pytest.fixture(scope="module")
def wide_corpus(spark):
    """A language of more than 100,000 distinct 4-grams, and 220 small ones."""
    r = random.Random(3)
    wide = [" ".join("".join(chr(r.randint(0x4E00, 0x5FFF)) for _ in range(3)) for _ in range(400)) for _ in range(100)]
    small = [(f"l{i:03}", f"{chr(0x6000 + i) * 5} {chr(0x6000 + i) * 3}") for i in range(220)]
    df = spark.createDataFrame([*[("wide", t) for t in wide], *small], "lang string, text string").repartition(3)
    return wide, small, langid.train(df, F.lit(True))


def test_models_hold_every_gram_and_language(wide_corpus):
    wide, small, models = wide_corpus
    top, shares = brute_kneser_ney(wide)
    m = models.models[models.names.index("wide")]
    assert len(top) > 100_000 and models.names == sorted(["wide", *[x for x, _ in small]])
    for k in (1, 2, 3, 4):
        hashes = langid.KneserNey._hash(np.array([[ord(c) for c in g] for g in shares[k]]))
        at, there = m.grams[k - 1].find(hashes)
        assert there.all() and len(m.grams[k - 1].hashes) == len(shares[k])
        assert np.allclose(m.grams[k - 1].values[0][at], list(shares[k].values()), rtol=1e-5)
    [(_, _, names, _, _)] = list(models.predict(pa.array([t for _, t in small])))
    assert names == [x for x, _ in small]


def test_calibration_is_over_all_training_grams(wide_corpus):
    wide, _, models = wide_corpus
    top, shares = brute_kneser_ney(wide)
    left = {k: collections.Counter() for k in shares}
    for k in shares:
        for g, x in shares[k].items():
            left[k][g[:-1]] += x

    def p(g):
        low = 1 / (len(shares[1]) + 1) if len(g) == 1 else p(g[1:])
        return shares[len(g)][g] + (1 - left[len(g)][g[:-1]]) * low

    costs, n = -np.log2([p(g) for g in top]), np.array(list(top.values()))
    mean = (n * costs).sum() / n.sum()
    m = models.models[models.names.index("wide")]
    assert abs(m.mean - mean) < 1e-3 and abs(m.deviation - np.sqrt((n * (costs - mean) ** 2).sum() / n.sum())) < 1e-3
    [(_, _, _, _, rejected)] = list(langid.Models({"wide": m}).predict(pa.array(wide)))
    assert not rejected.any()


# --- pipeline


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "line_dedup", "near_duplicates", "secret_scan", "packing"]
    stage = dict(c.STAGES)
    first = stage["language_id"](spark, docs, sf).cache()
    assert first.columns == docs.columns and first.count() >= 0.98 * docs.count()
    second = stage["line_dedup"](spark, first, sf).cache()
    want = {d: t for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in first.collect()])}
    assert {r.doc_id: r.text for r in second.collect()} == want and second.columns == docs.columns
    assert second.filter("n_chars <> length(text)").count() == 0
    third = stage["near_duplicates"](spark, second, sf).cache()
    keep = {d for d, n, c_ in brute_components([(r.doc_id, r.text) for r in second.collect()]) if d == c_}
    assert {r.doc_id for r in third.collect()} == keep and third.columns == docs.columns
    fourth = stage["secret_scan"](spark, third, sf).cache()
    texts = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        assert (r.text == texts[r.doc_id]) == (not brute_spans(texts[r.doc_id]) and "[SECRET]" not in r.text)
        assert not brute_spans(r.text)
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    check_packing(fourth)


def test_pipeline_odd_rows(spark, odd_docs, no_docs, sf):
    import corpus_pipeline as c

    for given in (odd_docs, no_docs):
        df = given
        for name, f in c.STAGES[:-1]:
            df = f(spark, df, sf)
            assert df.columns == given.columns, name
        c.STAGES[-1][1](spark, df, sf).count()


def test_pipeline_rows_that_share_an_id(spark, sf):
    import corpus_pipeline as c

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "s"), (3, f"{a} more", "s"), (3, b, "s"), (None, b, "t"), (None, b, "t"), (5, b, "s"), (5, b, "u"), (6, None, "s"), (7, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"k1": F.lit("x"), "row": F.lit(1), "__nth": F.lit(None).cast("int"), "a.b": F.lit(2)})
    got = dict(c.STAGES)["near_duplicates"](spark, df, sf)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, a), (3, b)]
    assert {r.doc_id for r in got.collect() if not r.text} == {6, 7}
