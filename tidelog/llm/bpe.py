"""Byte-level BPE encoding and decoding with segment trees over adjacent pair ranks.

A pre-token's bytes are symbols; leaf i of its tree holds (rank, i) of the pair that symbol i makes with
its right neighbour, or nothing. The root is the least leaf: the leftmost pair of lowest rank. Merging it
changes three leaves, each renewed with logarithmic work, until the root is empty. Trees of equal size
are worked on together as rows of arrays, so a step handles one merge of each of many pre-tokens.

Only the vocabulary and merge list come from the tokenizer's file. Strings of its added tokens inside a
text become those tokens, as in the library's default.

Defined results. Null or empty text: no ids. Repeated rows and doc_ids: each row is encoded. Empty table:
no rows. Other columns are not read. One pre-token may be as long as the text; its tree takes 40 bytes a byte.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._shared import forget_others, worker_cache
from .tokens import ChunkEncoder, byte_letters, tokenizer_path

#: Fixed value: the pre-tokenizer of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(1) << np.int64(62)
CELLS = 1 << 20
MEMO = 200_000


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        of_letter = {c: b for b, c in enumerate(letters)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            table[i] = token.encode()
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._find = regex.compile(PATTERN).findall
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (b >= 0) & (a >= 0), self._ranks[at], -1)

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lens = np.array([len(w) for w in words], np.int64)
        sizes = np.where(lens > 2, 1 << np.ceil(np.log2(np.maximum(lens - 1, 1))).astype(np.int64), 1)
        for m in np.unique(sizes):
            rows = np.flatnonzero(sizes == m)
            step = max(1, CELLS // int(m))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._trees([words[j] for j in part], lens[part], int(m)), strict=True):
                    out[i] = ids
        return out

    def _trees(self, words: list[bytes], lens: np.ndarray, m: int) -> list[bytes]:
        n = len(words)
        sym = np.full((n, m + 1), -1, np.int64)
        cells = np.arange(m + 1) < lens[:, None]
        sym[cells] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        spot = np.arange(m, dtype=np.int64)
        tree = np.full((n, 2 * m), NONE, np.int64)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank >= 0, (rank << 32) | at, NONE)

        tree[:, m:] = leaf(self._rank(sym[:, :-1], sym[:, 1:]), spot)
        level = m
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        right = np.where(np.arange(1, m + 2) < lens[:, None], np.arange(1, m + 2), -1)
        left = np.broadcast_to(np.arange(-1, m), (n, m + 1)).copy()

        def renew(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            i = at + m
            tree[rows, i] = value
            for _ in range(m.bit_length() - 1):
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at = root & 0xFFFFFFFF
            made = self._merged[root >> 32]
            gone = right[live, at]
            after = right[live, gone]
            sym[live, at] = made
            sym[live, gone] = -1
            right[live, at] = after
            has = after >= 0
            left[live[has], after[has]] = at[has]
            new = leaf(self._rank(made, np.where(has, sym[live, np.maximum(after, 0)], -1)), at)
            inner = gone < m  # the last symbol has no leaf
            renew(live[inner], gone[inner], np.full(int(inner.sum()), NONE))
            renew(live, at, new)
            before = left[live, at]
            had = before >= 0
            rows, b = live[had], before[had]
            renew(rows, b, leaf(self._rank(sym[rows, b], made[had]), b))
            live = live[tree[live, 1] < NONE]
        kept = sym >= 0
        ends = np.cumsum(kept.sum(1))
        flat = sym[kept].astype("<u4").tobytes()
        return [flat[4 * s : 4 * e] for s, e in zip(np.append(0, ends[:-1]), ends, strict=True)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of whole texts or of chunks of them (see tokens)."""
        young, old = self._young, self._old
        split: list[list] = []
        want: dict[str, bytes] = {}
        for c in chunks:
            parts: list = []
            for piece in self._split.split(c) if self._split and "<" in c else (c,):
                if piece in self.added:
                    parts.append(np.array([self.added[piece]], "<u4").tobytes())
                elif piece:
                    parts.extend(self._find(piece))
            split.append(parts)
            for w in parts:
                if isinstance(w, str) and w not in young and w not in want:
                    if (x := old.get(w)) is not None:
                        young[w] = x
                    else:
                        want[w] = b""
        found = self.words([w.encode() for w in want])
        young.update(zip(want, found, strict=True))
        out = [b"".join([young[w] if isinstance(w, str) else w for w in parts]) for parts in split]
        if len(young) > MEMO:
            self._young, self._old = {}, young
        return out

    def text_bytes(self, ids: np.ndarray, o: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids (offsets o), before UTF-8 decoding."""
        n = self.sizes[ids]
        ends = np.append(0, np.cumsum(n))
        data = self.flat[np.repeat(self.begins[ids] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = ends[o]
        return [data[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


_MODELS: dict[str, tuple[Bpe, ChunkEncoder]] = worker_cache()


def model(path: str) -> tuple[Bpe, ChunkEncoder]:
    """One for each worker process and file."""
    forget_others(_MODELS)
    if path not in _MODELS:
        bpe = Bpe(path)
        _MODELS[path] = bpe, ChunkEncoder(bpe.chunks)
    return _MODELS[path]


def _valid(data: bytes) -> bytes:
    """UTF-8 of the decoded text: invalid parts become U+FFFD."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()


def _coder(path: str, digest: bool):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = model(path)
        for batch in batches:
            own = batch.column(0)
            for lo, hi, ids, o in encoder(batch.column(1)):
                ids = ids.astype("<u4")
                texts = [_valid(x) for x in bpe.text_bytes(ids, o)]
                if digest:
                    cols = {
                        "ids_sha256": pa.array([hashlib.sha256(ids[s:e].tobytes()).hexdigest() for s, e in zip(o[:-1], o[1:], strict=True)]),
                        "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                    }
                else:
                    cols = {
                        "ids": pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(ids.astype(np.int32))),
                        "decoded": pa.array([x.decode() for x in texts], pa.string()),
                    }
                yield pa.RecordBatch.from_pydict({"doc_id": own.slice(lo, hi - lo), "n_tokens": pa.array(np.diff(o), pa.int64()), **cols})

    return code


def encode_decode(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of each row."""
    return docs.select("doc_id", "text").mapInArrow(_coder(tokenizer, False), "doc_id bigint, n_tokens bigint, ids array<int>, decoded string")


def encode_decode_digests(docs: DataFrame, *, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return docs.select("doc_id", "text").mapInArrow(
        _coder(tokenizer, True), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer=tokenizer_path("byte_bpe_50k.json"))
