"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.words import claim, pieces

ORDERS = (1, 2, 3)
PROFILE = 300
_NONE = -1
_FLUSH = 300_000
_MOST_WORDS = 300_000
#: N-grams that a worker keeps numbered before it forgets all but what its next texts hold.
_MOST_GRAMS = 1_000_000


def letters(word: str) -> str:
    """The letter runs of a word with one space between them."""
    return word if word.isalpha() else " ".join("".join(c if c.isalpha() else " " for c in word).split())


def gram_codes(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): the 1- to 3-grams of each word, runs of letters between spaces.

    All words are laid out in one row of code points with a space around each; a gram is the
    number that its code points form in steps of 21 bits. Three codes stand for each place (the
    letter, the pair that ends there, the triple around it); ``_NONE`` where there is no gram.
    """
    cp = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    space = cp == 32
    out = np.full((len(cp), 3), _NONE, dtype=np.int64)
    out[:, 0] = np.where(space, _NONE, cp)
    out[1:, 1] = cp[:-1] << 21 | cp[1:]
    out[1:-1, 2] = np.where(space[1:-1], _NONE, cp[:-2] << 42 | cp[1:-1] << 21 | cp[2:])
    sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) + 1
    return out[1:].ravel(), 3 * np.concatenate([[0], np.cumsum(sizes)])


def gram_text(code: int) -> str:
    out = ""
    while code:
        out = chr(code & 0x1FFFFF) + out
        code >>= 21
    return out


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, n`` over all rows with a language: the corpus counts of every n-gram.

    Workers add up words and then n-grams before the shuffle and pass them on whenever a table
    is full, so their memory is bounded and every occurrence is counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        words: dict[str, Counter] = defaultdict(Counter)
        totals: Counter = Counter()

        def fold() -> None:
            for key, own in words.items():
                pairs = [(r, n) for w, n in own.items() if (r := letters(w))]
                if pairs:
                    codes, ends = gram_codes([r for r, _ in pairs])
                    weights = np.repeat(np.array([n for _, n in pairs], dtype=np.float64), np.diff(ends))
                    found, at = np.unique(codes, return_inverse=True)
                    for code, n in zip(found.tolist(), np.bincount(at, weights).tolist(), strict=True):
                        if code != _NONE:
                            totals[key, code] += int(n)
            words.clear()

        def flush() -> pa.RecordBatch:
            keys, found = zip(*totals, strict=True)
            batch = pa.record_batch([pa.array(keys), pa.array(map(gram_text, found)), pa.array(list(totals.values()), pa.int64())], names=["lang", "gram", "n"])
            totals.clear()
            return batch

        for batch in batches:
            for rows in pieces(batch, "text"):
                for key, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    if t:
                        words[key].update(t.lower().split())
                if sum(map(len, words.values())) > _MOST_WORDS:
                    fold()
                    if len(totals) > _FLUSH:
                        yield flush()
        fold()
        if totals:
            yield flush()

    lean = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return lean.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, size: int = PROFILE) -> DataFrame:
    """``lang, gram, rank`` of the ``size`` most frequent n-grams; ties go by code-point order."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram"))
    # the filter on the plain number lets every task cut its rows to ``size`` a language before the exchange
    best = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    return best.select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class _Ranker:
    """Counts n-grams by number and measures distances to the profiles. Number 0 is no gram."""

    def __init__(self, table: dict[str, dict[str, int]], size: int):
        self.langs, self.size, self.table = sorted(table), size, table
        self._forget()

    def _forget(self) -> None:
        self.number: dict[int, int] = {_NONE: 0}
        self.order = np.zeros(1 << 12, dtype=np.uint32)
        self.rank = np.full((len(self.langs), 1 << 12), -1, dtype=np.int32)
        self.words: dict[str, np.ndarray] = {}

    def _gram(self, code: int) -> int:
        k = self.number.get(code)
        if k is None:
            k = self.number[code] = len(self.number)
            if k >= len(self.order):
                self.order = np.concatenate([self.order, np.zeros_like(self.order)])
                self.rank = np.concatenate([self.rank, np.full_like(self.rank, -1)], axis=1)
            gram = gram_text(code)
            self.order[k] = zlib.crc32(gram.encode())
            for i, lang in enumerate(self.langs):
                self.rank[i, k] = self.table[lang].get(gram, -1)
        return k

    def learn(self, words: set[str]) -> None:
        """Takes up the n-grams of words that are not known yet, all at once."""
        if len(self.number) >= _MOST_GRAMS:
            self._forget()
        if len(self.words) >= _MOST_WORDS:
            self.words = {}
        new = [w for w in words if w not in self.words]
        runs = [letters(w) for w in new]
        codes, ends = gram_codes([r for r in runs if r])
        found, at = np.unique(codes, return_inverse=True)
        numbers = np.array([self._gram(c) for c in found.tolist()], dtype=np.int32)[at] if len(found) else np.zeros(0, np.int32)
        k, empty, ends = 0, np.zeros(0, np.int32), ends.tolist()
        for word, r in zip(new, runs, strict=True):
            if r:
                self.words[word] = numbers[ends[k] : ends[k + 1]]
                k += 1
            else:
                self.words[word] = empty

    def bags(self, texts: list) -> list[Counter]:
        bags = [Counter(t.lower().split()) if t else Counter() for t in texts]
        self.learn(set().union(*bags))
        return bags

    def predict(self, bag: Counter) -> tuple[str, float]:
        lists = [self.words[w] for w in bag]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        if not sizes.sum() or not self.langs:
            return "und", 0.0
        ids = np.concatenate(lists)
        weights = np.repeat(np.fromiter(bag.values(), dtype=np.float64, count=len(bag)), sizes)
        counts = np.bincount(ids, weights)
        counts[0] = 0  # no gram
        there = np.flatnonzero(counts)
        if len(there) > self.size:
            edge = np.partition(counts[there], len(there) - self.size)[len(there) - self.size]
            there = there[counts[there] >= edge]
        there = there[np.lexsort((self.order[there], -counts[there]))][: self.size]
        rank = self.rank[:, there]
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(there)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(there))


def identify(docs: DataFrame, profile_rows: DataFrame, size: int = PROFILE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row from its whole text.

    The profile whose summed rank differences to the text's own most frequent n-grams are least
    wins; an n-gram that the profile lacks counts ``size``; ties go to the first name. ``score``
    is one minus the share of the largest possible distance. A null text, or one without a
    letter, is ``und`` with score 0. Repeated rows give repeated results; an empty table gives no
    rows; if no language was learned all rows are ``und``. Profiles hold at most ``size`` rows
    per language, so they are collected and sent to the workers. A null id is kept as it is; other
    columns are ignored, whatever their names. A very long text is read in one piece; words and
    n-grams that a worker has numbered are forgotten at a bounded size.
    """
    table: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, gram, rank in profile_rows.select("lang", "gram", "rank").collect():
        table[lang][gram] = rank
    sent = docs.sparkSession.sparkContext.broadcast(dict(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        ranker = _Ranker(sent.value, size)
        for batch in batches:
            for rows in pieces(batch, "text"):
                found = [ranker.predict(bag) for bag in ranker.bags(rows.column(1).to_pylist())]
                yield pa.record_batch([rows.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return lean.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4: those rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learns profiles from the rows that are not held out and predicts all rows.

    Rows with a null language are not learned from; rows with a null id are not held out. See
    ``identify`` for null, empty and very long texts, repeated rows, empty tables and other columns.
    """
    learned = profiles(gram_counts(docs.where(~held_out())))
    return identify(docs, learned).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
