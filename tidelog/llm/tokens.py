"""Token ids of whole texts, chunk by chunk.

A text is cut before each run of spaces and newlines that follows a visible ASCII or Latin-1 character;
at such places neither tokenizer family can join anything. Equal chunks get equal ids, so each distinct
chunk of a slice is encoded once, and the ids are gathered with array operations. Recent chunks are
remembered in two generations of `memo_max` each; what has been forgotten is encoded again.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ._shared import forget_others, worker_cache

#: Bytes of text handled at once; chunks that a Python worker remembers in a generation, and words and chunks of library_encoder.
SLICE_BYTES = 8 << 20
MEMO_MAX, WORDS_MAX = 300_000, 400_000

#: Fixed value: the pre-tokenizer of word_bpe files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """offsets (from 0) and bytes of an array of strings; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    large = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return (o - o[0]) if len(o) else np.zeros(1, np.int64), raw


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def chunk_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each of starts and before white space as the module says."""
    first = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        space = (raw == 32) | (raw == 10)
        seen = (raw > 32) & (raw < 127)
        seen[1:] |= (raw[1:] >= 0x80) & (raw[:-1] == 0xC3)
        first[1:-1] = space[1:] & seen[:-1]
    first[starts] = True
    first[len(raw)] = False
    return np.flatnonzero(first)


class ChunkEncoder:
    """encode(list of distinct chunks) -> list of bytes, each the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], *, fold: bool = False, memo_max: int = MEMO_MAX):
        self._encode, self._fold, self._most = encode, fold, memo_max
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets of the rows' ids) for slices of texts, in order."""
        offsets, raw = text_buffers(texts)
        for lo, hi in slices(offsets):
            o = offsets[lo : hi + 1] - offsets[lo]
            yield lo, hi, *self._slice(raw[offsets[lo] : offsets[hi]], o)

    def _slice(self, raw: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(o), np.int64)
        if self._fold:  # white space is dropped and letters are lowered, but for the strings of special tokens
            raw = np.where(raw == 10, np.uint8(32), raw)
            if b"<|" not in raw.tobytes():
                raw = _LOWER[raw]
        starts = chunk_starts(raw, o[:-1][o[:-1] < o[1:]])
        offs = np.append(starts, len(raw)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy()
        parts = self._ids(coded.dictionary.to_pylist())
        # 32 bits do: a slice is one text or a few megabytes, and texts end at 2 GB
        size = np.fromiter(map(len, parts), np.int32, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        n = size[index]
        ends = np.cumsum(n, dtype=np.int32)
        begin = (np.cumsum(size, dtype=np.int32) - size)[index]
        if not len(flat):
            return flat, np.zeros(len(o), np.int64)
        ids = flat[np.repeat(begin - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.append(0, ends).astype(np.int64)[np.searchsorted(starts, o)]

    def _ids(self, words: list[str]) -> list[bytes]:
        if not self._most:  # the encoder remembers by itself
            return self._encode(words)
        young, old = self._young, self._old
        parts = list(map(young.get, words))
        gone = [i for i, x in enumerate(parts) if x is None]
        missed = []
        for i in gone:
            w = words[i]
            x = parts[i] = old.get(w)
            if x is None:
                missed.append(i)
            else:
                young[w] = x
        if missed:
            for i, x in zip(missed, self._encode([words[i] for i in missed]), strict=True):
                parts[i] = young[words[i]] = x
        if len(young) > self._most:
            self._young, self._old = {}, young
        return parts


_LIBRARY: dict[str, ChunkEncoder] = worker_cache()


def library_cache() -> dict[str, ChunkEncoder]:
    """What a worker keeps of library_encoder."""
    return _LIBRARY


def library_encoder(path: str) -> ChunkEncoder:
    """A ChunkEncoder of the tokenizers library with add_special_tokens=False; one for each worker process and file.

    For tokenizers that lower letters and drop white space (word_bpe_49k.json)."""
    forget_others(_LIBRARY)
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        find, letters, tokenize = regex.compile(WORD_PATTERN).findall, byte_letters(), tokenizer.model.tokenize
        memo: dict[str, bytes] = {}

        def pre_token(w: str) -> bytes:
            said = w if w.isascii() else "".join(letters[b] for b in w.encode())
            return array("I", [t.id for t in tokenize(said)]).tobytes()

        def encode(words: list[str]) -> list[bytes]:
            # spaces around a chunk make no difference, so it is remembered without them, as are its pre-tokens
            words = [w.strip(" ") for w in words]
            out = list(map(memo.get, words))
            odd = []
            for i, ids in enumerate(out):
                if ids is not None:
                    continue
                w = words[i].lower()
                if not w or max(w) <= "\xff" and w.isprintable() and "<|" not in w:
                    # no normalisation but lowering applies, so only the library's model is needed, for each pre-token
                    parts = []
                    for x in find(w):
                        ids = memo.get(x)
                        if ids is None:
                            ids = memo[x] = pre_token(x)
                        parts.append(ids)
                    out[i] = memo[words[i]] = b"".join(parts) if len(parts) != 1 else parts[0]
                else:
                    odd.append(i)
            for at in range(0, len(odd), 1024):
                rows = odd[at : at + 1024]
                for i, x in zip(rows, tokenizer.encode_batch_fast([words[i] for i in rows], add_special_tokens=False), strict=True):
                    out[i] = memo[words[i]] = array("I", x.ids).tobytes()
            if len(memo) > WORDS_MAX:
                memo.clear()
            return out

        _LIBRARY[path] = ChunkEncoder(encode, fold=True, memo_max=0)
    return _LIBRARY[path]


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)
