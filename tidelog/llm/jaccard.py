"""N-gram Jaccard join: documents linked by the similarity of their word shingle sets, and their components.

The sets are rows of a sparse matrix of documents by shingles. Only a prefix of each row can matter for
a first meeting (the rows' shingles in one global order, frequent ones last): two sets with Jaccard
t or more share one there. Overlap counts of pairs are accumulated over the prefix columns and pairs
below the bound that their sizes give are discarded; what stays is compared whole.

Frequent shingles are found with a sketch of fixed size; it decides about order only, so its errors cost
time, never links. Equal sets are one node. The product is taken in three steps so that no group's pairs
are all made:
 1. stars: each column's nodes are compared with a few pivots of the column; links found give components;
 2. short columns (COLUMN nodes at most) whose nodes are still in several components: the pairs across;
 3. long columns of that kind: nodes outside the column's main component visit it, in blocks of BLOCK
    nodes by BLOCK visitors; a block gives one link for each visitor and component.
A pair inside one component needs no comparison for the components. Links are counted afterwards, where asked
for: linked sets share a component, so in each component of several nodes all pairs of nodes are compared, in
blocks of BLOCK by BLOCK; equal texts weigh as many links as there are copies.

Shingles are 48-bit hashes of word hashes; sets are compared by them. Nodes are 64-bit hashes of sets.
Defined results. Null, empty or blank text: empty set, linked with nothing. Fewer words than the shingle
size: the whole sequence is one shingle. Null doc_id: no part in a component's least id (null if all are
null). Rows with the same doc_id: each is a document with its own set. Repeated rows: each comes back.
Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lean, remove, small_batches, spent_shuffles_go, stored_bytes, workspace, written
from .components import components
from .tokens import slices, text_buffers

WORDS, PERCENT = 5, 80
CELL_BITS, RANGE_BITS, COLUMN, BLOCK, PIVOTS = 22, 6, 64, 512, 3
NODE_BITS, MOST_NODE_BITS, SEEN = 24, 28, 1 << 20
#: Bytes of a text that are hashed at once.
PART = 512 << 10
#: Pairs are verified in parts only where their sets take more bytes than this.
LEAST_PART = 64 << 20
MASK48 = np.uint64((1 << 48) - 1)
_P = 0x9E3779B97F4A7C15 | 1
_MULT = np.array([pow(_P, k + 3, 1 << 64) for k in range(WORDS)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Sorted distinct 48-bit shingle hashes of each text, slice by slice."""

    def __init__(self, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent = words, percent
        self._up = _powers(_P, 1)
        self._down = self._up

    def _word_hashes(self, raw: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the offsets of each text's words. Texts of over PART bytes are taken in parts, cut before white space."""
        if len(raw) <= 2 * PART:
            return self._part_hashes(raw, o)
        found, at, n = [], 0, 0
        offsets = np.zeros(len(o), np.int64)
        while at < len(raw):
            end = min(at + PART, len(raw))
            while end < len(raw):  # to the next white space
                look = raw[end : end + PART]
                space = np.flatnonzero((look == 32) | ((look >= 9) & (look <= 13)))
                end += int(space[0]) if len(space) else len(look)
                if len(space):
                    break
            lo, hi = np.searchsorted(o, [at, end], "left")
            inner = np.concatenate([[0], o[lo:hi] - at, [end - at]])
            h, wo = self._part_hashes(raw[at:end], inner)
            offsets[lo:hi] = n + wo[1:-1]
            found.append(h)
            at, n = end, n + len(h)
        offsets[np.searchsorted(o, len(raw), "left") :] = n
        return np.concatenate(found), offsets

    def _part_hashes(self, raw: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words hash as polynomials, read off running sums."""
        lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.zeros(len(raw) + 1, bool)
        edge[o] = True
        before = np.append(True, space[:-1]) | edge[:-1]
        after = np.append(space[1:], True) | edge[1:]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        up, down = self._up, self._down
        if len(up) <= len(raw):
            up, down = _powers(_P, len(raw) + 1), _powers(pow(_P, -1, 1 << 64), len(raw) + 1)
            if len(raw) <= 4 * PART:  # those of a longer word are not kept
                self._up, self._down = up, down
        sums = np.append(np.uint64(0), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64))
        h = (sums[ends] - sums[starts]) * down[starts]
        return _mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, o)

    def sets(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        offsets, raw = text_buffers(texts)
        k = self.words
        for lo, hi in slices(offsets, PART):
            o = offsets[lo : hi + 1] - offsets[lo]
            w, wo = self._word_hashes(raw[offsets[lo] : offsets[hi]], o)
            padded = np.append(w, np.zeros(k, np.uint64))
            h = np.zeros(len(w), np.uint64)
            for j in range(k):
                h += padded[j : j + len(w)] * _MULT[j % WORDS] * np.uint64(2 * (j // WORDS) + 1)
            h = _mix(h) & MASK48
            out = []
            for s, e in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True):
                if e - s >= k:
                    out.append(np.unique(h[s : e - k + 1]))
                elif e > s:  # the whole short sequence, apart from any full shingle
                    whole = np.uint64(e - s)
                    for x in w[s:e]:
                        whole = _mix(np.array([(int(whole) * _P + int(x)) % (1 << 64)], np.uint64))[0]
                    out.append(np.array([whole & MASK48], np.uint64))
                else:
                    out.append(np.zeros(0, np.uint64))
            yield lo, out


def pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").ravel()


def prefix_length(n, percent: int = PERCENT):
    return n + (-(percent * n) // 100) + 1  # n - ceil(percent * n / 100) + 1


def needed_overlap(a, b, percent: int = PERCENT):
    """Least intersection of linked sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


def _sketch(shingler: Shingler):
    """Counts of shingles in 2**CELL_BITS cells, in 2**RANGE_BITS compressed parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, "<u4")
        for batch in batches:
            for _, sets in shingler.sets(batch.column(0)):
                if sets:
                    np.add.at(cells, (np.concatenate(sets) >> np.uint64(48 - CELL_BITS)).astype(np.int64), np.uint32(1))
        parts = cells.reshape(1 << RANGE_BITS, -1)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(len(parts)), pa.int32()),
            "counts": pa.array([zlib.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in parts], pa.binary()),
        })

    return count


def _frequent_part(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << (CELL_BITS - RANGE_BITS), np.int64)
    for data in frame["counts"]:
        total += np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    mean = total.mean()
    often = total > mean + max(COLUMN, 8 * np.sqrt(mean))
    return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "bits": [np.packbits(often).tobytes()]})


def frequent_cells(docs: DataFrame, shingler: Shingler) -> np.ndarray:
    """Bitmap over all cells of those that hold clearly more than a cell's mean; its size is fixed (512 KB)."""
    counted = docs.select("text").mapInArrow(lean(_sketch(shingler)), "part int, counts binary")
    found = counted.groupBy("part").applyInPandas(_frequent_part, "part int, bits binary").collect()
    none = np.zeros(1 << (CELL_BITS - RANGE_BITS - 3), np.uint8)
    parts = {r["part"]: np.frombuffer(r["bits"], np.uint8) for r in found}
    return np.concatenate([parts.get(i, none) for i in range(1 << RANGE_BITS)])


def _coder(shingler: Shingler, bits):
    """doc_id, k1, k2, node (hash of the set), n, toks: the set in the global order."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(bits.value)
        for batch in batches:
            for lo, sets in shingler.sets(batch.column(3)):
                nodes, toks = [], []
                for s in sets:
                    late = often[(s >> np.uint64(48 - CELL_BITS)).astype(np.int64)] == 1
                    data = pack48(np.concatenate([s[~late], s[late]]))
                    toks.append(data)
                    nodes.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True))
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(i).slice(lo, len(sets)) for i, c in enumerate(("doc_id", "k1", "k2"))},
                    "node": pa.array(nodes, pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "toks": pa.array(toks, pa.binary()),
                })

    return code


def _prefix_rows(percent: int):
    """t, node, n for the prefix columns of each node, once for each task."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # spares the exchange some of a hot node's rows; _shared_rows drops the others
        for batch in batches:
            t, node, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, n, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if n and i not in seen:
                    if len(seen) < SEEN:
                        seen.add(i)
                    p = prefix_length(n, percent)
                    t.append(unpack48(memoryview(toks.as_buffer())[: 6 * p]))
                    node.append(np.full(p, i))
                    size.append(np.full(p, n))
            yield pa.RecordBatch.from_pydict({
                "t": pa.array(np.concatenate(t).astype(np.int64)), "node": pa.array(np.concatenate(node)), "n": pa.array(np.concatenate(size)),
            })

    return explode


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by t and node, those whose column has another node, distinct; also the first and last
    column of the partition, which may go on in its neighbours.

    Holds one row from batch to batch: the last one, if its column has no other node yet."""
    last: tuple[int, int] | None = None  # t and node of the row before
    waits: list[np.ndarray] | None = None
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(3)]
        t, node = cols[0], cols[1]
        new = np.append(last != (t[0], node[0]), (t[1:] != t[:-1]) | (node[1:] != node[:-1]))
        before = None if last is None else last[0]
        last = int(t[-1]), int(node[-1])
        cols = [c[new] for c in cols]
        t = cols[0]
        if not len(t):
            continue
        if first is None:
            first = t[0]
        out = []
        if waits is not None and waits[0][0] == t[0]:
            out.append(waits)
        shared = np.append(before == t[0], t[1:] == t[:-1]) | np.append(t[1:] == t[:-1], False) | (t == first)
        waits = None if shared[-1] else [c[-1:] for c in cols]
        out.append([c[shared] for c in cols])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["t", "node", "n"])
    if waits is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in waits], ["t", "node", "n"])


def _keep_nodes(bits, size: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = bits.value
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            at = nodes & ((1 << size) - 1)
            good = (on[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            for i in np.flatnonzero(good):
                if nodes[i] in seen:
                    good[i] = False
                elif len(seen) < SEEN:
                    seen.add(nodes[i])
            yield batch.filter(pa.array(good))

    return keep


def sets_of(coded: DataFrame, nodes: DataFrame, given: list) -> DataFrame:
    """node, n, toks of the given nodes (of some others too while a bitmap chooses them); distinct.

    A bitmap of some 8 places a node, 2 to 32 MB, keeps most other sets out of the exchange; where more nodes are asked
    for, the table of nodes itself does. The bitmap comes to the driver in one job, not in one for each partition. given: takes the broadcast, to be released when the result has been read."""
    nodes = nodes.select("node").distinct()
    k = nodes.count()
    size = min(max(NODE_BITS, (8 * k).bit_length()), MOST_NODE_BITS)
    kept = coded.select("node", "n", "toks")
    if 2 * k > 1 << size:
        kept = kept.join(nodes, "node", "left_semi")
    else:
        cell = F.col("node").bitwiseAND(F.lit((1 << size) - 1))
        rows = (
            nodes.select(cell.alias("c")).groupBy(F.expr("bitmap_bucket_number(c)").alias("b"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("bits")).collect()
        )
        # Spark's buckets are of 32768 positions; bucket 1 begins at position 1, bucket 0 holds position 0 alone
        on = np.zeros((1 << size) // 8 + 8192, np.uint8)
        for r in rows:
            flags = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
            base = (r["b"] - 1) * 32768 + 1 if r["b"] > 0 else 0
            at = base + np.flatnonzero(flags)
            np.bitwise_or.at(on, at // 8, (1 << (at % 8)).astype(np.uint8))
        given.append(coded.sparkSession.sparkContext.broadcast(on))
        kept = kept.mapInArrow(lean(_keep_nodes(given[-1], size)), "node bigint, n bigint, toks binary")
    return kept.groupBy("node").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))


def _linked(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpack48(a.as_buffer()), unpack48(b.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return check


def _parts(pairs: DataFrame, coded_bytes: int) -> int:
    """In how many parts pairs (x, y, nx, ny) are verified, so that the sets a part moves take no more bytes than the table of all sets.

    Sets of distinct x travel once and again for each of their pairs; those of distinct y are a table and travel from it."""
    x = pairs.groupBy("x").agg(F.first("nx").alias("n"), F.count("*").alias("k")).agg(F.expr("sum(n * (k + 1))")).first()[0] or 0
    y = pairs.groupBy("y").agg(F.first("ny").alias("n")).agg(F.expr("sum(2 * n)")).first()[0] or 0
    return max(1, -(-6 * (x + y) // max(coded_bytes, LEAST_PART)))


def verified(pairs: DataFrame, coded: DataFrame, at: str, percent: int, given: list, coded_bytes: int) -> DataFrame:
    """The pairs (x, y) of sets of nx and ny shingles whose whole sets are similar enough.

    The sets of all x come out of one exchange already dealt by x; those of y, which many x may share, lie in a
    table, so that both sides of that join are plain exchanges which Spark may split where a y is hot. Pairs are
    taken in parts by x, one after the other, where all their sets at once would take too much disk."""
    spark = pairs.sparkSession
    every = written(pairs.select("x", "y", "nx", "ny"), f"{at}/pairs")
    n = _parts(every, coded_bytes)
    links = None
    for i in range(n):
        some = every.filter(F.pmod(F.xxhash64(F.lit(n), "x"), F.lit(n)) == i) if n > 1 else every
        some = some.select("x", "y")
        left = sets_of(coded, some.select(F.col("x").alias("node")), given).select(F.col("node").alias("x"), F.col("toks").alias("a"))
        right = written(sets_of(coded, some.select(F.col("y").alias("node")), given), f"{at}/sets{i}").select(F.col("node").alias("y"), F.col("toks").alias("b"))
        met = some.join(left, "x").join(right, "y").select("x", "y", "a", "b")
        found = written(met.mapInArrow(lean(_linked(percent)), "x bigint, y bigint"), f"{at}/links{i}")
        remove(spark, f"{at}/sets{i}")
        links = found if links is None else links.unionByName(found)
    return links


def _visit(percent: int):
    """One link of each visitor to each other component in a block of nodes."""

    def visit(frame: pd.DataFrame) -> pd.DataFrame:
        items = frame[~frame["visits"]].reset_index(drop=True)
        guests = frame[frame["visits"]]
        out: list[tuple[int, int]] = []
        if len(items) and len(guests):
            toks = [unpack48(x) for x in items["toks"]]
            sizes = np.array([len(x) for x in toks])
            owner = np.repeat(np.arange(len(toks)), sizes)
            flat = np.concatenate(toks)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            labels, nodes = items["label"].to_numpy(), items["node"].to_numpy()
            for node, label, data in zip(guests["node"], guests["label"], guests["toks"], strict=True):
                x = unpack48(data)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                ends = np.cumsum(n)
                if not len(ends) or not ends[-1]:
                    continue
                at = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
                both = np.bincount(owner[at], minlength=len(toks))
                good = (100 * both >= percent * (len(x) + sizes - both)) & (both > 0) & (labels != label)
                _, one = np.unique(labels[good], return_index=True)
                out += [(node, y) for y in nodes[good][one]]
        return pd.DataFrame(out, columns=["x", "y"]).astype("int64")

    return visit


def _count(percent: int):
    """Of the nodes of two blocks (i, j) of a component: node, links, the documents of the other block that each is linked with."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        items = frame[frame["s"] == i]
        guests = frame[frame["s"] == j]
        if not len(items) or not len(guests):
            return pd.DataFrame({"node": [], "links": []}).astype("int64")
        toks = [unpack48(x) for x in items["toks"]]
        sizes = np.array([len(x) for x in toks])
        flat = np.concatenate(toks)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(toks)), sizes)[order]
        words, starts = np.unique(flat[order], return_index=True)
        starts = np.append(starts, len(flat))
        nodes, copies = items["node"].to_numpy(), items["copies"].to_numpy()
        of_items, of_guests = np.zeros(len(nodes), np.int64), []
        for node, own, data in zip(guests["node"], guests["copies"], guests["toks"], strict=True):
            x = unpack48(data)
            at = np.minimum(np.searchsorted(words, x), len(words) - 1)
            at = at[words[at] == x]
            lo, n = starts[at], starts[at + 1] - starts[at]
            ends = np.cumsum(n)
            both = np.bincount(owner[np.repeat(lo - (ends - n), n) + np.arange(n.sum())], minlength=len(toks))
            good = (100 * both >= percent * (len(x) + sizes - both)) & (both > 0) & (nodes != node)
            of_guests.append(copies[good].sum())
            of_items[good] += own
        links = np.array(of_guests, np.int64)
        if i == j:
            return pd.DataFrame({"node": guests["node"].to_numpy(), "links": links})
        return pd.DataFrame({"node": np.append(guests["node"].to_numpy(), nodes), "links": np.append(links, of_items)})

    return count


def link_counts(coded: DataFrame, named: DataFrame, at: str, percent: int, given: list) -> DataFrame:
    """node, links for the nodes of components (node, copies, label) that have several: documents with other sets linked with each."""
    sizes = named.groupBy("label").agg(F.count("*").alias("k")).filter("k > 1").select("label", F.expr(f"int((k + {BLOCK - 1}) div {BLOCK})").alias("nb"))
    members = written(named.join(sizes, "label").withColumn("s", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")), f"{at}/members")
    sets = written(sets_of(coded, members, given), f"{at}/member_sets")
    placed = members.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "node", "copies", "label", "s", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j")
    )
    met = placed.join(sets.select("node", "toks"), "node")
    return met.groupBy("label", "i", "j").applyInPandas(_count(percent), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))


def _bound(c, nx: str, ny: str, percent: int):
    """Whether c shared prefix columns leave the needed overlap possible."""
    ceil = lambda n: F.expr(f"({percent} * {n} + 99) div 100")
    need = F.expr(f"({percent} * ({nx} + {ny}) + {100 + percent - 1}) div {100 + percent}")
    return F.greatest(ceil(nx), ceil(ny)) - 1 + c >= need


def _fits(percent: int):
    """Whether the sizes allow the similarity."""
    return F.expr(f"100 * nx >= {percent} * ny AND 100 * ny >= {percent} * nx")


def jaccard_components(
    docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, links: bool = False, key: tuple[Column, Column] | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; with links also n_links, the number of other rows it is linked with.

    With key, two bigints that name a row, also k1, k2 and leads: whether it is the row with the least doc_id (null last),
    then key, of its component, or without a set. Rows of equal doc_id, text and key lead together."""
    k1, k2 = key or (F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    with small_batches(docs.sparkSession), spent_shuffles_go(docs.sparkSession):
        rows = docs.select("doc_id", k1.alias("__k1"), k2.alias("__k2"), "text").toDF("doc_id", "k1", "k2", "text")
        out = _jaccard_components(rows, words, percent, links)
    return out if key else out.drop("k1", "k2", "leads")


def _jaccard_components(rows: DataFrame, words: int, percent: int, counted_links: bool) -> DataFrame:
    spark = rows.sparkSession
    at = workspace(spark, "jaccard")
    shingler = Shingler(words, percent)
    bits = spark.sparkContext.broadcast(frequent_cells(rows, shingler))
    given = [bits]
    coded = written(rows.mapInArrow(lean(_coder(shingler, bits)), "doc_id bigint, k1 bigint, k2 bigint, node bigint, n bigint, toks binary"), f"{at}/coded")
    coded_bytes = stored_bytes(spark, f"{at}/coded")

    prefix = coded.select("node", "n", "toks").mapInArrow(lean(_prefix_rows(percent)), "t bigint, node bigint, n bigint")
    dealt = prefix.repartitionByRange("t", "node").sortWithinPartitions("t", "node")
    # rows of one node from several tasks meet at column boundaries only as repeats; distinct again for those
    shared = written(dealt.mapInArrow(lean(_shared_rows), "t bigint, node bigint, n bigint").distinct(), f"{at}/shared")

    # 1. stars
    pivots = [F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node", "n")).alias(f"p{r}") for r in range(PIVOTS)]
    columns = written(shared.groupBy("t").agg(F.count("*").alias("f"), *pivots).filter("f > 1"), f"{at}/columns")
    star = (
        shared.join(columns, "t")
        .select("node", "n", F.explode(F.array_distinct(F.array(*[F.struct(f"p{r}.node", f"p{r}.n") for r in range(PIVOTS)]))).alias("p"))
        .filter(F.col("p.node") != F.col("node"))
        .groupBy(F.col("node").alias("x"), F.col("p.node").alias("y")).agg(F.count("*").alias("c"), F.first("n").alias("nx"), F.first("p.n").alias("ny"))
        .filter(_fits(percent)).filter(_bound(2 * F.col("c"), "nx", "ny", percent))
        .groupBy("x").agg(
            F.first("nx").alias("nx"), F.max_by(F.struct("y", "ny"), F.struct("c", "y")).alias("y1"), F.min_by(F.struct("y", "ny"), F.struct(-F.col("c"), "y")).alias("y2")
        )
        .select("x", "nx", F.explode(F.array_distinct(F.array("y1", "y2"))).alias("y")).select("x", "y.y", "nx", "y.ny")
    )
    links1 = verified(star, coded, f"{at}/star", percent, given, coded_bytes)
    labels1 = written(components(links1, f"{at}/round1"), f"{at}/labels1")

    # columns that still hold several components
    labelled = written(
        shared.join(columns.select("t", "f"), "t").join(labels1, "node", "left").withColumn("label", F.coalesce("label", "node")), f"{at}/labelled"
    )
    remove(spark, f"{at}/shared")
    remove(spark, f"{at}/columns")
    ends = labelled.groupBy("t").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("f").alias("f"))
    open_ = written(ends.filter("lo <> hi").select("t", "f"), f"{at}/open")

    # 2. short columns: the pairs across components
    short = written(labelled.join(open_.filter(f"f <= {COLUMN}").select("t"), "t").select("t", "node", "n", "label"), f"{at}/short")
    a = short.select("t", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"))
    b = short.select("t", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"))
    counted = a.join(b, "t").filter("x < y AND lx <> ly").filter(_fits(percent)).groupBy("x", "y").agg(F.count("*").alias("c"), F.first("nx").alias("nx"), F.first("ny").alias("ny"))
    # a pair may share long columns too; those are counted in step 3, where both meet again
    long_ = written(labelled.join(open_.filter(f"f > {COLUMN}").select("t"), "t").select("t", "node", "n", "label"), f"{at}/long")
    remove(spark, f"{at}/labelled")
    in_long = long_.groupBy("node").agg(F.count("*").alias("k"))
    extra = (
        counted.join(in_long.select(F.col("node").alias("x"), F.col("k").alias("kx")), "x", "left")
        .join(in_long.select(F.col("node").alias("y"), F.col("k").alias("ky")), "y", "left")
        .withColumn("c", F.col("c") + F.least(F.coalesce("kx", F.lit(0)), F.coalesce("ky", F.lit(0))))
    )
    links2 = verified(extra.filter(_bound(F.col("c"), "nx", "ny", percent)), coded, f"{at}/across", percent, given, coded_bytes)
    remove(spark, f"{at}/short")

    # 3. long columns: visitors of the main component
    main = (
        long_.groupBy("t", "label").agg(F.count("*").alias("k"))
        .groupBy("t").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    )
    guests = written(
        long_.join(written(main, f"{at}/main"), "t").filter("label <> main").select("main", "node", "label").distinct(), f"{at}/guests"
    )
    mains = guests.select("main").distinct()
    alone = long_.select("node", "label").filter("node = label").distinct()
    hosts = labels1.unionByName(alone).distinct().join(mains, F.col("label") == F.col("main"), "inner").select("main", "node", "label")
    items = written(hosts.unionByName(guests).distinct(), f"{at}/items")
    n_items = items.groupBy("main").agg(F.count("*").alias("k")).select("main", F.expr(f"int((k + {BLOCK - 1}) div {BLOCK})").alias("ni"))
    n_guests = guests.groupBy("main").agg(F.count("*").alias("k")).select("main", F.expr(f"int((k + {BLOCK - 1}) div {BLOCK})").alias("ng"))
    grid = written(n_items.join(n_guests, "main"), f"{at}/grid")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = (
        items.join(grid, "main").select("main", "node", "label", F.lit(False).alias("visits"), spot("ni").alias("i"), every("ng").alias("g"))
        .unionByName(guests.join(grid, "main").select("main", "node", "label", F.lit(True).alias("visits"), every("ni").alias("i"), spot("ng").alias("g")))
    )
    sets = written(sets_of(coded, items, given), f"{at}/visit_sets")
    met = placed.join(sets.select("node", "toks"), "node")
    links3 = met.groupBy("main", "i", "g").applyInPandas(_visit(percent), "x bigint, y bigint")

    links = links1.unionByName(links2).unionByName(links3)
    labels = components(links, f"{at}/round2")
    for spent in ("long", "guests", "items", "visit_sets"):  # the links have been read
        remove(spark, f"{at}/{spent}")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    classes = coded.filter("n > 0").groupBy("node").agg(first, F.count("*").alias("copies"))
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("first"))
    of_node = named.select("node", "label").join(least, "label").select("node", "first")
    if counted_links:
        named = written(named.select("node", "copies", "label"), f"{at}/named")
        others = written(link_counts(coded, named, at, percent, given), f"{at}/link_counts")
        total = named.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        of_node = of_node.join(total, "node")
    # the hot nodes of large groups of copies spread by a salt; the other side is repeated for each
    salts = 16
    docs_ = coded.select("doc_id", "k1", "k2", "node", "n").withColumn("salt", F.pmod(F.xxhash64("doc_id", "k1"), F.lit(salts)).cast("int"))
    salted = of_node.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = docs_.join(salted, ["node", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "k1", "k2",
        ((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")))).alias("leads"),
        *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if counted_links else []),
    )
    out = written(out, workspace(spark, "jaccard-out"))
    remove(spark, at)
    for b in given:
        b.unpersist()
    return out


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)
