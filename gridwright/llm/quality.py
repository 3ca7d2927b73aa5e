"""Quality classification by co-training a text view and a page-metadata view.

Both views are first fitted on a bounded sample of labelled rows. In each round every other row of
the corpus is scored; what one view is sure of is a pseudo-label for the other, which takes bounded
Newton steps on the labelled rows and on sums over all pseudo-labelled ones. The sums are added up by Spark,
so only as many numbers as the Hessians have reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.words import buffers, claim, pieces, word_hashes
from gridwright.session import fresh_path

#: Labelled rows that the classifiers are fitted and calibrated on, at most. All other rows of the
#: corpus take part in the exchange of pseudo-labels, and scores are computed for every document.
LABELLED = 12_000
#: Rounds of exchange, bounded Newton steps of a round, and the logit from which a view is sure (odds of 55 to 1).
ROUNDS, STEPS, SURE = 3, 2, 4.0
RIDGE = 3.0
BUCKETS = 128
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _BANG, _SYMBOL, _HIGH = range(8)
_CLASS = np.full(256, _SYMBOL, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[44, 46, 39, 45, 59, 58]] = _STOP
_CLASS[[33, 63]] = _BANG


def text_features(texts: pa.Array) -> np.ndarray:
    """Content of each text: character classes, repetition, and hashed byte trigrams."""
    data, offs = buffers(texts)
    n, sizes = len(texts), np.diff(offs)
    row = np.repeat(np.arange(n), sizes)
    classes = np.bincount(row * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8) / np.maximum(sizes, 1)[:, None]
    grams = np.zeros((n, BUCKETS))
    if len(data) > 2:
        d = data.astype(np.uint32)
        h = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        inside = row[:-2] == row[2:]
        at = (row[:-2] * BUCKETS + (h >> np.uint32(25)).astype(np.int64))[inside]
        grams = np.bincount(at, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(sizes, 1)[:, None]
    hashes, ends = word_hashes(texts)
    words = np.diff(ends)
    shape = np.zeros((n, 6))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b > a:
            own = hashes[a:b]
            _, counts = np.unique(own, return_counts=True)
            again = np.count_nonzero(own[1:] == own[:-1])
            shape[k] = len(counts) / len(own), counts.max() / len(own), again / len(own), np.sqrt((counts.astype(float) ** 2).sum()) / len(own), sizes[k] / len(own) / 10, len(counts) / np.sqrt(len(own)) / 10
    return np.concatenate([classes, shape, np.log1p(words)[:, None] / 10, np.sqrt(grams)], axis=1)


def meta_features(lang: list, source: list, n_chars: list, texts: pa.Array) -> np.ndarray:
    """What is known of a page without its words: language, source, size and line layout."""
    data, offs = buffers(texts)
    sizes = np.diff(offs)
    row = np.repeat(np.arange(len(texts)), sizes)
    lines = np.bincount(row[data == 10], minlength=len(texts)) + 1.0
    chars = np.array([c if c is not None and c >= 0 else s for c, s in zip(n_chars, sizes, strict=True)], dtype=float)
    out = np.zeros((len(texts), 52))
    for k in range(len(texts)):
        out[k, zlib.crc32((lang[k] or "").encode()) % 16] = 1
        out[k, 16 + zlib.crc32((source[k] or "").encode()) % 32] = 1
    out[:, 48], out[:, 49] = np.log1p(chars) / 10, np.log(lines) / 5
    out[:, 50], out[:, 51] = np.log1p(chars / lines) / 10, sizes / np.maximum(chars, 1) - 1
    return out


@dataclass
class Logistic:
    """Ridge logistic regression fitted by Newton steps on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ridge: float = RIDGE

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def sums(self, z: np.ndarray, y: np.ndarray, bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss over rows of the design; ``bound`` gives the largest
        Hessian that there can be, with which a step always lowers the loss."""
        p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
        return z.T @ (p - y), z.T @ z / 4 if bound else (z * (p * (1 - p) + 1e-9)[:, None]).T @ z

    def stepped(self, gradient: np.ndarray, hessian: np.ndarray) -> Logistic:
        penalty = np.full(len(self.weights), self.ridge)
        penalty[-1] = 1e-6
        return replace(self, weights=self.weights - np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * self.weights))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> Logistic:
        model = cls(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(x.shape[1] + 1), ridge)
        z = model.design(x)
        for _ in range(steps):
            before, model = model.weights, model.stepped(*model.sums(z, y))
            if np.abs(model.weights - before).max() < 1e-6:
                break
        return model

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    calibrate: list[Logistic]
    combine: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by each view, and of both combined."""
        a = self.calibrate[0].logit(self.text.logit(text)[:, None])
        b = self.calibrate[1].logit(self.meta.logit(meta)[:, None])
        both = self.combine.logit(np.stack([a, b], axis=1))
        return tuple(1 / (1 + np.exp(-v)) for v in (a, b, both))


Views = tuple[Logistic, Logistic]


def pseudo_sums(teachers: Views, students: Views, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """For each student view and class: rows, gradient and upper half of the Hessian over the rows
    whose class the other view's teacher is sure of, one after the other."""
    out, views = [], (text, meta)
    for side in (0, 1):
        sure = teachers[1 - side].logit(views[1 - side])
        for label in (0, 1):
            z = students[side].design(views[side][sure > SURE if label else sure < -SURE])
            gradient, hessian = students[side].sums(z, np.full(len(z), float(label)), bound=True)
            out += [[len(z)], gradient, hessian[np.triu_indices(len(gradient))]]
    return np.concatenate(out)


def _parts(flat: np.ndarray, sizes: list[int]) -> list[list[tuple[float, np.ndarray, np.ndarray]]]:
    """By view and class what ``pseudo_sums`` put together."""
    out, at = [], 0
    for size in sizes:
        own = []
        for _ in (0, 1):
            upper = np.zeros((size, size))
            upper[np.triu_indices(size)] = flat[at + 1 + size : at + 1 + size + size * (size + 1) // 2]
            own.append((flat[at], flat[at + 1 : at + 1 + size], upper + np.triu(upper, 1).T))
            at += 1 + size + size * (size + 1) // 2
        out.append(own)
    return out


def _reliable(logit: np.ndarray, y: np.ndarray, label: int) -> float:
    """How much more often than by chance a teacher is right where it is sure of a class: 1 always, 0
    no more often than the class is there."""
    prior = np.mean(y == label)
    sure = y[logit > SURE if label else logit < -SURE]
    right = (np.count_nonzero(sure == label) + prior) / (len(sure) + 1)
    return max(0.0, (right - prior) / (1 - prior))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, others: Callable[[Views, Views], np.ndarray | None], rounds: int = ROUNDS) -> CoTrained:
    """Fits both views on labelled rows (``y`` 0 or 1) that are not ``held`` and on all other rows.

    ``others(teachers, students)`` adds up ``pseudo_sums`` over all rows without a label (None: there
    are none). A pseudo-labelled row weighs at most r / R of a labelled one in round r of R, all those
    of a class no more than the labelled rows of that class, so their number does not drown the
    labels; and as much less as their teacher is wrong on held rows (``_reliable``). Held labelled
    rows also calibrate each view and their combination.
    """
    views, fitted = (text, meta), np.flatnonzero(~held)
    test = np.flatnonzero(held)
    known = [v[fitted] for v in views]
    own = y[fitted].astype(float)
    models: Views = tuple(Logistic.fit(v, own) for v in known)
    for turn in range(1, rounds + 1):
        teachers = models
        trust = [[_reliable(t.logit(v[test]), y[test], label) for label in (0, 1)] for t, v in zip(teachers, views, strict=True)]
        for _ in range(STEPS):
            flat = others(teachers, models)
            if flat is None:
                break
            stepped = []
            for side, (model, v, classes) in enumerate(zip(models, known, _parts(flat, [len(m.weights) for m in models]), strict=True)):
                gradient, hessian = model.sums(model.design(v), own, bound=True)
                for label, (n, g, h) in enumerate(classes):
                    if n:
                        weight = turn / rounds * min(1.0, np.count_nonzero(own == label) / n) * trust[1 - side][label]
                        gradient, hessian = gradient + weight * g, hessian + weight * h
                stepped.append(model.stepped(gradient, hessian))
            models = tuple(stepped)
    raw = [m.logit(v[test]) for m, v in zip(models, views, strict=True)]
    calibrate = [Logistic.fit(r[:, None], y[test].astype(float), ridge=1.0) for r in raw]
    both = np.stack([c.logit(r[:, None]) for c, r in zip(calibrate, raw, strict=True)], axis=1)
    return CoTrained(models[0], models[1], calibrate, Logistic.fit(both, y[test].astype(float), ridge=1.0))


def _view_rows(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    column = lambda n, t: F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n)
    return docs.select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))


def _rows_of(binary: pa.Array) -> np.ndarray:
    """A column of packed 32-bit numbers as a matrix."""
    values = binary.to_pylist()
    return np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1).astype(float)


def _others(features: DataFrame) -> Callable[[Views, Views], np.ndarray | None]:
    """``pseudo_sums`` over the rows without a label, added up by Spark cell by cell."""
    rows = features.where("y < 0").select("t", "m")

    def told(teachers: Views, students: Views) -> np.ndarray | None:
        sent = features.sparkSession.sparkContext.broadcast((teachers, students))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("quality")
            total = None
            for batch in batches:
                if batch.num_rows:
                    flat = pseudo_sums(*sent.value, _rows_of(batch.column(0)), _rows_of(batch.column(1)))
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["cell", "value"])

        # as many rows as cells: about 26 000, whatever the corpus
        cells = rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()
        return cells["value"].to_numpy() if len(cells) else None

    return told


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits the two views on at most ``labelled`` labelled rows, picked by a hash of the id, and on
    the pseudo-labels of all other rows.

    Only the labelled rows' features (about 200 numbers each) and sums reach the driver; the
    features of all rows are kept in the shared folder. Labels other than 0 and 1 and null ids are
    ignored; of repeated labels the smallest counts; labelled rows beyond ``labelled`` count as
    unlabelled. Returns None if either class is missing from the part that is fitted or the part
    that calibrates.
    """
    spark = docs.sparkSession
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    picked = present.join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled).collect()
    if not picked:
        return None
    sample = spark.createDataFrame([(r["doc_id"], r["y"]) for r in picked], "doc_id long, y int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            for rows in pieces(batch, "text", 2 << 20):
                t = text_features(rows.column(1)).astype(np.float32)
                m = meta_features(*(rows.column(k).to_pylist() for k in (2, 3, 4)), rows.column(1)).astype(np.float32)
                yield pa.record_batch([rows.column(0), rows.column(5).fill_null(-1), pa.array([x.tobytes() for x in t]), pa.array([x.tobytes() for x in m])], names=["doc_id", "y", "t", "m"])

    # at most ``labelled`` rows of two numbers: a proven size for the broadcast
    path = fresh_path(spark, "features")
    views = _view_rows(docs).join(F.broadcast(sample), "doc_id", "left")
    views.mapInArrow(run, "doc_id long, y int, t binary, m binary").write.parquet(path)
    features = spark.read.parquet(path)
    rows = sorted(features.where("y >= 0").collect(), key=lambda r: (r["doc_id"], bytes(r["t"])))
    ids, y = np.array([r["doc_id"] for r in rows]), np.array([r["y"] for r in rows])
    text, meta = (np.stack([np.frombuffer(r[c], np.float32) for r in rows]).astype(float) for c in ("t", "m"))
    held = np.array([zlib.crc32(b"held%d" % k) % 4 == 0 for k in ids.tolist()])
    if any(len(set(y[part])) < 2 for part in (held, ~held)):
        return None
    return co_train(text, meta, y, held, _others(features), rounds)


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` for every row; ``kept`` if score >= threshold.

    Scores are calibrated probabilities of good quality from the whole text. Without a model
    (no labels to learn from) all scores are 1 and every row is kept. A null or empty text is
    scored as an empty one; missing or null metadata count as unknown; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    rows = _view_rows(docs)
    if model is None:
        one = F.lit(1.0)
        return rows.select("doc_id", one.alias("text_score"), one.alias("meta_score"), one.alias("score"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                t = text_features(part.column(1))
                m = meta_features(*(part.column(k).to_pylist() for k in (2, 3, 4)), part.column(1))
                a, b, both = sent.value.scores(t, m)
                yield pa.record_batch([part.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Trains on ``labels`` (``doc_id, quality``) and scores every row of ``docs``."""
    return score(docs, train(docs, labels), threshold)
