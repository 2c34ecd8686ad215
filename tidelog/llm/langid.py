"""Language identification with interpolated Kneser-Ney character models.

For each language a model of order ORDER over the characters of its words (letters only, lowered, with
word ends) gives a word's probability; a document's language is the one with the lowest cross-entropy
per character. The models' n-grams are stored as sorted arrays of 64-bit hashes with their values.

Training counts the n-grams of every labelled text, in each task over distinct words and then across
tasks. All n-grams of all languages go into the models: lower orders are continuation counts, discounts are
n1 / (n1 + 2 n2) at each order, and both are computed in Spark over the whole counts. The driver and each
Python worker hold the finished models: 12 bytes for each distinct n-gram and context of each order.

Rejection is calibrated on all training counts: scored by the finished models, they give the mean and the
variance of a character's cost in its own language, and a document is rejected if its cost per character is above
RATIO * mean + SIGMAS * deviation / sqrt(characters). A text without a letter is `und` and rejected.
score is the winner's share of exp(-SHARPNESS * cross-entropy) over the languages, times the chance scale of rejection (halved if rejected).

Defined results. Null or empty text, or no letter: `und`, score 0. No labelled row: every text is `und`.
Null lang: not learned. Null doc_id: its remainder counts as 0, so it is learned from. Ties: the first
language in order of name. Repeated rows: each counts and each comes back. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import give_back, lean, parts, planned_bytes, remove, small_batches, stored_bytes, workspace, written
from .tokens import slices

ORDER = 4
RATIO, SIGMAS, SHARPNESS = 1.6, 6.0, 4.0
UNKNOWN = "und"
NO_LETTERS = r"\P{L}+"
SLICE = 4 << 20
MEMO = 300_000
#: Words whose grams are made at once.
BLOCK = 1 << 14
#: With more languages than this, slices and the memory of words' costs get shorter, as each word has a cost in each language.
WIDE = 16
CHAR = (1 << 21) - 1

_C = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(ORDER)]


def _words(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct words, index of each word, offsets of the rows' words) for slices of texts."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in slices(np.append(0, np.cumsum(sizes)), size):
        part = pc.utf8_lower(texts.slice(lo, hi - lo))
        lists = pc.split_pattern(pc.replace_substring_regex(part, NO_LETTERS, " "), " ")
        coded = lists.flatten().dictionary_encode()
        yield lo, hi, coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _grams(words: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the grams of each length 1..order that end at each character (word end included), and each one's word.

    A word is led by order-1 marks, so a gram never looks past its word."""
    lens = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    width = lens + order  # marks, letters, end
    total = int(width.sum())
    start = np.cumsum(width) - width
    line = np.ones(total, np.uint64)  # 1: the mark before a word
    owner = np.repeat(np.arange(len(words)), lens)
    line[np.arange(len(chars)) - np.repeat(np.cumsum(lens) - lens, lens) + start[owner] + order - 1] = chars
    line[start + width - 1] = 2  # the word's end
    at = np.repeat(start + order - 1 - (np.cumsum(lens + 1) - (lens + 1)), lens + 1) + np.arange(int((lens + 1).sum()))
    out, h = [], np.zeros(len(at), np.uint64)
    for j in range(order):
        h = h + (line[at - j] + np.uint64(3)) * _C[j]
        g = h ^ (h >> np.uint64(29))
        out.append((g * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(j)).astype(np.uint64))
    return out, np.repeat(np.arange(len(words)), lens + 1)


def _gram_keys(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The order characters of each highest gram, packed (21 bits each), and its word."""
    lens = np.array([len(w) for w in words], np.int64)
    marks, end = "\x01" * (order - 1), "\x02"
    line = np.frombuffer("".join(f"{marks}{w}{end}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    width = lens + order
    start = np.cumsum(width) - width
    at = np.repeat(start + order - 1 - (np.cumsum(lens + 1) - (lens + 1)), lens + 1) + np.arange(int((lens + 1).sum()))
    hi = (line[at - 3] << np.uint64(21)) | line[at - 2]
    lo = (line[at - 1] << np.uint64(21)) | line[at]
    return np.stack([hi, lo], 1), np.repeat(np.arange(len(words)), lens + 1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (rows of two numbers), sorted, and the sum of each one's n."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, n = keys[order], n[order]
    new = np.append(True, (keys[1:] != keys[:-1]).any(1))
    return keys[new], np.add.reduceat(n, np.flatnonzero(new))


def _counted(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of words' highest grams and their counts."""
    names, counts, parts = list(words), np.fromiter(words.values(), np.int64, len(words)), []
    for at in range(0, len(names), BLOCK):
        keys, word = _gram_keys(names[at : at + BLOCK])
        parts.append(_summed(keys, counts[at : at + BLOCK][word]))
    return parts[0] if len(parts) == 1 else _summed(*map(np.concatenate, zip(*parts, strict=True)))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a (first two characters), b (last two), n: of each task's texts."""
    held: dict[str, dict[str, int]] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, sums = _counted(held.pop(lang))
        keys = keys.astype(np.int64)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(keys)), "a": pa.array(keys[:, 0]), "b": pa.array(keys[:, 1]), "n": pa.array(sums),
        })

    for batch in batches:
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column(1).filter(pc.equal(langs, lang))
            for _, _, words, index, _ in _words(texts):
                own = held.setdefault(lang, {})
                for w, n in zip(words.to_pylist(), np.bincount(index, minlength=len(words)).tolist(), strict=True):
                    if w:
                        own[w] = own.get(w, 0) + n
                if sum(map(len, held.values())) > MEMO:
                    yield out(max(held, key=lambda x: len(held[x])))
        give_back()
    for lang in [x for x, words in held.items() if words]:  # a task may have seen no letter of a language
        yield out(lang)


class Table:
    """Values by 64-bit hash: sorted hashes, and the values in that order."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], [v[order].astype(np.float32) for v in values]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


class KneserNey:
    """One language: grams[k] has the discounted share of each gram of k+1 characters, contexts[k] the weight left to the order below."""

    def __init__(self, grams: list[Table], contexts: list[Table | None], letters: int, rest: float):
        """letters: one more than the known characters; rest: what is left to all characters alike."""
        self.grams, self.contexts, self.letters, self.rest = grams, contexts, letters, rest
        self.mean = self.deviation = 0.0  # of a character's cost, see calibrate

    @staticmethod
    def _hash(lines: np.ndarray, context: bool = False) -> np.ndarray:
        """As _grams: the last character first; a context is seen from the place after it."""
        h = np.zeros(len(lines), np.uint64)
        for j in range(lines.shape[1]):
            h = h + (lines[:, -1 - j].astype(np.uint64) + np.uint64(3)) * _C[j]
        g = h ^ (h >> np.uint64(29))
        return g * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(max(lines.shape[1] - 1, 0))

    def _all(self, lines: np.ndarray):
        return [self._hash(lines[:, ORDER - k :]) for k in range(1, ORDER + 1)], [self._hash(lines[:, ORDER - k : -1]) for k in range(2, ORDER + 1)]

    def costs(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Bits of each character, from the hashes of the grams that end there and of the contexts before it."""
        at, there = self.grams[0].find(grams[0])
        p = np.where(there, self.grams[0].values[0][at] if len(self.grams[0].hashes) else 0, 0) + self.rest / self.letters
        for k in range(1, ORDER):
            at, there = self.contexts[k].find(contexts[k - 1])
            left = np.where(there, self.contexts[k].values[0][at], 1.0)
            at, there = self.grams[k].find(grams[k])
            p = np.where(there, self.grams[k].values[0][at], 0.0) + left * p
        return -np.log2(p)


class Models:
    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self._index: dict[str, int] = {}
        self._rows = np.zeros((0, len(self.names)), np.float32)

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language."""
        grams, owner = _grams(words)
        # the context of a place is the gram of one character less that ends just before it; at a word's first place, marks
        contexts = []
        for k in range(1, ORDER):
            before = np.append(np.uint64(0), grams[k - 1][:-1])
            first = np.append(True, owner[1:] != owner[:-1])
            before[first] = KneserNey._hash(np.full((1, k), 1))[0]
            contexts.append(before)
        # the highest gram says all shorter ones and the contexts, and few of them are distinct
        _, one, each = np.unique(grams[-1], return_index=True, return_inverse=True)
        grams, contexts = [g[one] for g in grams], [c[one] for c in contexts]
        out = np.zeros((len(words), len(self.models)))
        for i, m in enumerate(self.models):
            out[:, i] = np.bincount(owner, weights=m.costs(grams, contexts)[each], minlength=len(words))
        return out

    def bits(self, words: list[str]) -> np.ndarray:
        """word_bits of distinct words; up to MEMO words are remembered between calls."""
        index = self._index
        if len(index) > MEMO * WIDE // max(WIDE, len(self.names)):
            index.clear()
            self._rows = self._rows[:0]
        missed = [w for w in words if w not in index]
        if missed:
            index.update(zip(missed, range(len(index), len(index) + len(missed)), strict=True))
            blocks = [self.word_bits(missed[at : at + BLOCK]).astype(np.float32) for at in range(0, len(missed), BLOCK)]
            self._rows = np.concatenate([self._rows, *blocks])
        return self._rows[np.fromiter(map(index.__getitem__, words), np.int64, len(words))]

    def forget(self) -> None:
        """Drops the remembered words."""
        self._index, self._rows = {}, self._rows[:0].copy()

    def predict(self, texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
        """(first row, end row, languages, scores, rejected) for slices of texts."""
        for lo, hi, words, index, o in _words(texts, SLICE * WIDE // max(WIDE, len(self.names))):
            names = words.to_pylist()
            lens = np.array([len(w) + 1 if w else 0 for w in names], np.int64)
            doc = np.repeat(np.arange(hi - lo), np.diff(o))
            chars = np.bincount(doc, weights=lens[index], minlength=hi - lo)
            if not self.models or not len(names):
                yield lo, hi, [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
                continue
            table = self.bits(names)
            table[lens == 0] = 0  # a copy: indexed by an array
            cost = np.stack([np.bincount(doc, weights=table[index, i], minlength=hi - lo) for i in range(len(self.models))], 1)
            cost /= np.maximum(chars, 1)[:, None]
            best = cost.argmin(1)
            share = np.exp(-SHARPNESS * (cost - cost.min(1, keepdims=True)))
            score = 1 / share.sum(1)
            mean = np.array([m.mean for m in self.models])[best]
            deviation = np.array([m.deviation for m in self.models])[best]
            rejected = cost[np.arange(hi - lo), best] > RATIO * mean + SIGMAS * deviation / np.sqrt(np.maximum(chars, 1))
            score = np.where(chars > 0, np.where(rejected, score / 2, score), 0.0)
            names_ = [self.names[b] if c else UNKNOWN for b, c in zip(best, chars, strict=True)]
            yield lo, hi, names_, score, rejected | (chars == 0)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def levels(counted: DataFrame) -> DataFrame:
    """lang, k, a, b, n for the grams of each length k: the counts of the highest, in how many contexts a shorter one occurs."""
    out = level = counted.select("lang", F.lit(ORDER).alias("k"), "a", "b", "n")
    for k, a, b in ((3, F.col("a").bitwiseAND(F.lit(CHAR)), F.col("b")), (2, F.lit(0), F.col("b")), (1, F.lit(0), F.col("b").bitwiseAND(F.lit(CHAR)))):
        level = level.groupBy("lang", a.cast("bigint").alias("a"), b.alias("b")).agg(F.count("*").alias("n")).select("lang", F.lit(k).alias("k"), "a", "b", "n")
        out = out.unionByName(level)
    return out


def shares(grams: DataFrame, at: str, n: int) -> tuple[DataFrame, DataFrame]:
    """lang, k, context, a, b, value of each gram and each context; lang, letters, rest of each language. n: partitions of a table at most."""
    ones, twos = F.sum((F.col("n") == 1).cast("bigint")), F.sum((F.col("n") == 2).cast("bigint"))
    d = F.least(F.greatest(ones / F.greatest(ones + 2 * twos, F.lit(1)), F.lit(0.1)), F.lit(0.95))
    discounts = written(grams.groupBy("lang", "k").agg(d.alias("d")).coalesce(n), f"{at}/discounts")
    before = F.shiftright("b", 21).alias("before")
    found = grams.groupBy("lang", "k", "a", before).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    contexts = written(found.join(discounts, ["lang", "k"]).coalesce(n), f"{at}/contexts")
    left = F.col("d") * F.col("kinds") / F.col("total")
    own = grams.select("*", before).join(contexts, ["lang", "k", "a", "before"]).select(
        "lang", "k", F.lit(False).alias("context"), "a", "b", ((F.col("n") - F.col("d")) / F.col("total")).cast("float").alias("value")
    )
    of_contexts = contexts.filter("k > 1").select("lang", "k", F.lit(True).alias("context"), "a", F.col("before").alias("b"), left.cast("float").alias("value"))
    rest = contexts.filter("k = 1").select("lang", (F.col("kinds") + 1).alias("letters"), left.alias("rest"))
    return own.unionByName(of_contexts), rest


def _lines(a: np.ndarray, b: np.ndarray, k: int = ORDER, context: bool = False) -> np.ndarray:
    """The characters of packed grams of length k, or of the contexts before their last one."""
    if context:
        return np.stack([a >> 21, a & CHAR, b], 1)[:, ORDER - k :]
    return np.stack([a >> 21, a & CHAR, b >> 21, b & CHAR], 1)[:, ORDER - k :]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted shares: lang, k, context and the hashes and values of each run of theirs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, runs = batch.column(0).dictionary_encode(), [batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
        runs.append(langs.indices.to_numpy())
        a, b, value = (batch.column(i).to_numpy() for i in (3, 4, 5))
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in runs], 0)) + 1
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            k, context = int(runs[0][lo]), bool(runs[1][lo])
            hashes = KneserNey._hash(_lines(a[lo:hi], b[lo:hi], k, context), context)
            out.append((langs.dictionary[runs[2][lo]].as_py(), k, context, hashes.tobytes(), value[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
            ["lang", "k", "context", "hashes", "shares"],
        )


def _moments(models):
    """lang, n, s, q: the number of training characters, the sum of their costs and of the costs' squares."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(zip(models.value.names, models.value.models, strict=True))
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                a, b, n = (batch.column(i).filter(pc.equal(batch.column(0), lang)).to_numpy() for i in (1, 2, 3))
                costs = own[lang].costs(*own[lang]._all(_lines(a, b)))
                yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [int(n.sum())], "s": [float((n * costs).sum())], "q": [float((n * costs**2).sum())]})

    return score


def calibrate(models: Models, counted: DataFrame) -> None:
    """Mean and deviation of a character's cost in its own language, over all counted grams."""
    given = counted.sparkSession.sparkContext.broadcast(models)
    found = counted.select("lang", "a", "b", "n").mapInArrow(_moments(given), "lang string, n bigint, s double, q double")
    own = dict(zip(models.names, models.models, strict=True))
    for r in found.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect():
        own[r["lang"]].mean = r["s"] / r["n"]
        own[r["lang"]].deviation = max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) ** 0.5
    given.unpersist()


def train(docs: DataFrame, learn: Column) -> Models:
    """Models of the labelled rows of docs (text, lang) where learn holds."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(lean(_counter), "lang string, a bigint, b bigint, n bigint").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    spark = docs.sparkSession
    at = workspace(spark, "langid")
    with small_batches(spark):
        table = written(counted.coalesce(parts(spark, planned_bytes(rows))), f"{at}/counts")
    n = parts(spark, stored_bytes(spark, f"{at}/counts"))
    found, rest = shares(written(levels(table).coalesce(n), f"{at}/grams"), at, n)
    sorted_ = found.orderBy("lang", "k", "context", "a", "b").coalesce(n)
    runs = sorted_.mapInArrow(_packed, "lang string, k int, context boolean, hashes binary, shares binary")
    held: dict[tuple[str, int, bool], list[tuple[bytes, bytes]]] = {}
    for r in written(runs, f"{at}/tables").toLocalIterator():
        held.setdefault((r["lang"], r["k"], r["context"]), []).append((r["hashes"], r["shares"]))

    def taken(lang: str, k: int, context: bool) -> Table:
        hashes, values = zip(*held.pop((lang, k, context)), strict=True)
        return Table(np.frombuffer(b"".join(hashes), np.uint64), np.frombuffer(b"".join(values), np.float32))

    orders = range(1, ORDER + 1)
    models = Models({
        r["lang"]: KneserNey(
            [taken(r["lang"], k, False) for k in orders], [taken(r["lang"], k, True) if k > 1 else None for k in orders], r["letters"], r["rest"]
        )
        for r in rest.collect()
    })
    calibrate(models, table)
    remove(spark, at)
    return models


FOUND = "lang string, score double, rejected boolean"


def scorer(spark: SparkSession, models: Models) -> Callable[[Column], Column]:
    """Function of a text column that gives struct(lang, score, rejected).

    Texts alone go to Python; the rows' other columns stay where they are. The models are broadcast, and given
    up with the function; words are remembered for a task only."""
    given = spark.sparkContext.broadcast(models)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for _, _, names, scores, rejected in given.value.predict(texts):
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"],
                ))
                give_back()
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))
        given.value.forget()

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scored)(batches)

    return F.arrow_udf(score, FOUND)


def predict(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """The columns keep of docs, with __lang, __score and __rejected from its text; columns of these names are replaced."""
    names = ("lang", "score", "rejected")
    kept = [F.col(f"`{c}`") for c in keep if c not in {f"__{x}" for x in names}]
    found = docs.select(F.struct(*kept, F.lit(0).alias("__")).alias("row"), scorer(docs.sparkSession, models)(F.col("text")).alias("found"))
    out = found.select("row.*", *[F.col(f"found.{x}").alias(f"__{x}") for x in names])
    return out.drop("__")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(spark, models)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
