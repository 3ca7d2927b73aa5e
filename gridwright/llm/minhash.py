"""Near-duplicate groups by MinHash with tensored banding and verification on full sets.

A document has ``M`` half-keys of ``H`` MinHash values. Every pair of half-keys forms one table
key of ``2 * H`` values, so ``M * H`` hash functions serve ``M * (M - 1) / 2`` tables: about the
square root of what separate tables need. With M = 24 and H = 4 two documents of Jaccard
similarity s share a table key with probability 1 - (1 - p)**M - M * p * (1 - p)**(M - 1),
p = s**4: 0.99994 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.words import claim, mix, ngram_hashes, pieces, split_words, word_hashes
from gridwright.operators.components import connected_components
from gridwright.session import cut

M, H = 24, 4
#: Smallest members of its buckets that a document is tried against first. What they leave apart is
#: compared inside the buckets, so this number changes the work and not the result.
HUBS = 3
#: Shingles of a bucket that one task holds at a time; larger buckets are compared block by block.
BLOCK_SHINGLES = 2_000_000
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, M * H, dtype=np.uint64) | np.uint64(1)
_ADDENDS = np.random.default_rng(78).integers(1, 2**63, M * H, dtype=np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``words`` lower-cased words, or
    the whole sequence if there are fewer; none without words."""
    hashes, rows = word_hashes(texts, lower=True)
    every = ngram_hashes(hashes, words)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            out.append(ngram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, M) keys; a document without shingles has no use for its row."""
    sizes = np.array([len(s) for s in sets])
    keys = np.zeros((len(sets), M), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return keys
    flat = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    low = np.empty((M * H, len(full)), dtype=np.uint64)
    # blocks of documents that fit the processor's cache, every hash function over each block
    edges = [0]
    for k in range(1, len(full)):
        if starts[k] - starts[edges[-1]] > 16_384:
            edges.append(k)
    edges.append(len(full))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        end = starts[b] if b < len(full) else len(flat)
        part, at = flat[starts[a] : end], starts[a:b] - starts[a]
        for f in range(M * H):
            low[f, a:b] = np.minimum.reduceat(part * _MULTIPLIERS[f] + _ADDENDS[f], at)
    for j in range(M):
        key = np.full(len(full), j, dtype=np.uint64)
        for f in range(j * H, j * H + H):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[f])
        keys[full, j] = key
    return keys


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, digest, halves``: set size, SHA-256 of the lower-cased words, half-keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            for rows in pieces(batch, "text", 2 << 20):
                sets = shingle_sets(rows.column(1), words)
                keys = half_keys(sets).view(np.int64)
                yield pa.record_batch(
                    [
                        rows.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(split_words(t)).lower()).digest() for t in rows.column(1).to_pylist()], pa.binary()),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), M).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "halves"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, halves array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, shingles`` (sorted, distinct) of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            for rows in pieces(batch, "text", 2 << 20):
                sets = shingle_sets(rows.column(1), words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.record_batch([rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _linked(a: str, b: str, percent: int):
    """100 * intersection >= percent * union of two set columns."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


class _Sketches:
    """Parity sketches of sets in order of size: a bit per hash class, set if an odd number of
    shingles fall in it. Two sketches differ in at most as many bits as the sets in shingles.

    A sketch has about four bits a shingle; a larger one is folded to the width of a smaller one.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.level = np.array([max(9, len(s).bit_length() + 2) for s in sets])
        self.begin, self.rows = {}, {}
        for level in np.unique(self.level).tolist():
            members = np.flatnonzero(self.level == level)
            sketch = np.zeros((len(members), (1 << level) // 64), dtype=np.uint64)
            for row, k in zip(sketch, members.tolist(), strict=True):
                where = (sets[k] >> np.uint64(20)) & np.uint64((1 << level) - 1)
                np.bitwise_xor.at(row, (where >> np.uint64(6)).astype(np.int64), np.uint64(1) << (where & np.uint64(63)))
            self.begin[level], self.rows[level, level] = members[0], sketch

    def _folded(self, level: int, to: int) -> np.ndarray:
        if (level, to) not in self.rows:
            wide = self._folded(level, to + 1)
            half = wide.shape[1] // 2
            self.rows[level, to] = wide[:, :half] ^ wide[:, half:]
        return self.rows[level, to]

    def apart(self, k: int, others: np.ndarray) -> np.ndarray:
        """At most the size of the symmetric difference of set ``k`` and each of the larger ``others``."""
        to = int(self.level[k])
        own, out = self.rows[to, to][k - self.begin[to]], np.empty(len(others), dtype=np.int64)
        for level in np.unique(self.level[others]).tolist():
            at = np.flatnonzero(self.level[others] == level)
            out[at] = np.bitwise_count(self._folded(level, to)[others[at] - self.begin[level]] ^ own).sum(axis=1)
        return out


def bucket_links(ids: list[int], components: list[int], parts: list[int], sets: list[np.ndarray], percent: int, cross: bool) -> list[tuple[int, int]]:
    """Links that join different components among the members of one bucket, each verified.

    Every pair of different components is considered; set sizes and parity sketches pass over
    only pairs that cannot reach the threshold. ``cross``: only pairs of different parts. The
    sketches take about half a byte a shingle, whatever the sizes are.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    label = np.unique(np.array(components, dtype=np.int64), return_inverse=True)[1][order]
    part = np.array(parts)[order]
    sketches = _Sketches(sets)
    top = np.searchsorted(size, size * 100 // percent, side="right")
    t = percent / 100
    # |A ^ B| = |A| + |B| - 2 I and I >= t / (1 + t) (|A| + |B|)
    most = 1 - 2 * t / (1 + t) + 1e-9
    out = []
    for k in range(len(sets) - 1):
        open_ = label[k + 1 : top[k]] != label[k]
        if cross:
            open_ &= part[k + 1 : top[k]] != part[k]
        rest = k + 1 + np.flatnonzero(open_)
        if not len(rest):
            continue
        apart = sketches.apart(k, rest)
        near = apart <= most * (size[k] + size[rest])
        for j in rest[near][np.argsort(apart[near], kind="stable")].tolist():
            if label[j] == label[k]:
                continue
            both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[k] + size[j] - both):
                label[label == label[j]] = label[k]
                out.append((ids[order[k]], ids[order[j]]))
    return out


def _missing_links(members: DataFrame, percent: int) -> DataFrame:
    """``a, b`` for links between components inside the same bucket.

    ``members``: ``key, block, crossed, doc_id, component, shingles, part`` where ``block`` names the pair of
    parts to compare. Rows are sorted by bucket and read in a stream: one block pair in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        rows: list[tuple] = []

        def links() -> pa.RecordBatch | None:
            if len({r[2] for r in rows}) < 2:
                return None
            found = bucket_links([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], percent, rows[0][5])
            return pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            key, block, doc, comp, part, crossed = (batch.column(k).to_pylist() for k in range(6))
            lists = batch.column(6)
            flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k in range(batch.num_rows):
                if rows and rows[0][0] != (key[k], block[k]):
                    if (found := links()) is not None:
                        yield found
                    rows = []
                rows.append(((key[k], block[k]), doc[k], comp[k], part[k], flat[offs[k] : offs[k + 1]].view(np.uint64), crossed[k]))
        if rows and (found := links()) is not None:
            yield found

    ordered = members.select("key", "block", "doc_id", "component", "part", "crossed", "shingles").repartition("key", "block").sortWithinPartitions("key", "block", "doc_id")
    return ordered.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", hubs_tried: int = HUBS, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    ``words``-word shingles (ASCII lower-cased; a shorter text is one shingle). A component is
    named by its smallest id, which is the one kept. A text without words is in no set and
    linked with nothing. Ids are expected to be unique; rows with the same id share a fate and
    are returned as often as they came. A row with a null id is judged by nobody: it comes back
    with a null component and ``kept`` true. An empty table gives no rows; other columns are
    ignored.

    Steps: (1) signatures, cut in the shared folder; (2) documents with the same lower-cased words
    (by SHA-256) become one representative; (3) half-keys that two representatives share; (4) table
    keys from pairs of those; each member of a bucket is verified on full sets against the smallest
    ids of its ``hubs_tried`` best buckets; (5) components; (6) buckets that still hold several components
    are compared inside, all pairs of different components, on full sets (see ``_apart``); (7)
    components again. So every pair that shares a table key is either verified or already in one
    component. Only candidates' sets are read; no step collects rows to the driver and none emits
    all pairs of a bucket.
    """
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = cut(signatures(lean, words))
    ids = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = cut(ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reps = ids.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    # counts are cut before rows are joined with them: a join of two exchanges can be split where
    # one key is hot, a join with an aggregate of the same exchange cannot
    half = reps.select("doc_id", "n_shingles", F.explode("halves").alias("half"))
    shared = cut(half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    lists = cut(half.join(shared, "half", "left_semi").groupBy("doc_id", "n_shingles").agg(F.array_sort(F.collect_list("half")).alias("h")).where(F.size("h") > 1))

    # table keys: pairs of the half-keys that a document shares with another one
    keyed = lists.select("doc_id", F.explode(_pairs("h")).alias("key"))
    hubs = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"))
    stars = keyed.join(hubs, "key").where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
    rank = F.struct(-F.col("n"), F.col("hub"))
    best = stars.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, hubs_tried).alias("best"))
    tries = cut(best.select("doc_id", F.explode(F.transform("best", lambda x: x["hub"])).alias("hub")))

    wanted = cut(tries.select("doc_id").unionByName(hubs.select(F.col("hub").alias("doc_id"))).distinct())
    sets = cut(full_sets(lean.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), words))
    links = (
        tries.join(sets, "doc_id")
        .join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("other")), "hub")
        .where(_linked("shingles", "other", percent))
        .select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    )
    links = cut(links)
    members = _apart(lists.join(wanted, "doc_id", "left_semi"), connected_components(links), block)
    more = _missing_links(members.join(sets, "doc_id"), percent)

    copies = ids.join(same.where("n > 1").select("digest", "rep"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionByName(more).unionByName(copies))
    out = sig.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _pairs(halves: str) -> Column:
    """The table keys of a sorted list of half-keys: one for each pair of them."""
    return F.flatten(F.transform(halves, lambda x, i: F.transform(F.slice(halves, i + 2, F.size(halves)), lambda y: F.xxhash64(x, y))))


def _mixed(rows: DataFrame) -> DataFrame:
    """``key, w`` of the buckets that hold several components, with their shingles; of buckets with
    the same members one stands for all."""
    content = [F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"), F.sum("n_shingles").alias("w")]
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *content).where("lo <> hi")
    return mixed.groupBy("x", "y", "w").agg(F.min("key").alias("key")).select("key", "w")


def _apart(lists: DataFrame, first: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``key, block, crossed, doc_id, component, part`` of the buckets to be compared inside.

    Two documents that share a table key share two half-keys. If one of these has at most ``block``
    shingles in its bucket, they meet there. If both have more, they meet in the bucket of the table
    key, which is compared part by part where it is large as well; members of its largest component
    are in parts of their own, which are not compared with each other, so one huge group beside a
    few strays costs no more than its size times the strays' parts.
    """
    component = F.coalesce("component", "doc_id").alias("component")
    known = cut(lists.join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", "h", component))
    halves = known.select("doc_id", "n_shingles", "component", F.explode("h").alias("key"))
    mixed = cut(_mixed(halves))
    light = halves.join(mixed.where(F.col("w") <= block).select("key"), "key")
    light = light.select("key", "doc_id", "component", F.lit(0).alias("part"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("crossed"))

    # content is not compared here: each heavy half-key must keep its own table keys
    heavy = cut(halves.groupBy("key").agg(F.sum("n_shingles").alias("w"), F.min("component").alias("lo"), F.max("component").alias("hi")).where((F.col("w") > block) & (F.col("lo") != F.col("hi"))).select("key"))
    if heavy.isEmpty():
        return light
    own = halves.join(heavy, "key").groupBy("doc_id", "n_shingles", "component").agg(F.array_sort(F.collect_list("key")).alias("h")).where(F.size("h") > 1)
    rows = cut(own.select("doc_id", "n_shingles", "component", F.explode(_pairs("h")).alias("key")))
    mixed = cut(_mixed(rows))
    of_component = rows.join(mixed.where(F.col("w") > block).select("key"), "key").groupBy("key", "component").agg(F.sum("n_shingles").alias("own"))
    bulk = of_component.groupBy("key").agg(F.max_by(F.struct("component", "own"), F.struct("own", "component")).alias("bulk"))
    rest, most = F.col("w") - F.coalesce("bulk.own", F.lit(0)), F.coalesce("bulk.own", F.lit(0))
    plan = mixed.join(bulk, "key", "left").select(
        "key", F.col("bulk.component").alias("largest"), F.ceil(rest / block).cast("int").alias("few"), F.ceil(most / block).cast("int").alias("many")
    )
    in_bulk = F.coalesce(F.col("component") == F.col("largest"), F.lit(False))
    width = F.col("few") + F.col("many")
    part = F.when(in_bulk, F.col("few") + F.pmod(F.xxhash64("doc_id"), "many")).otherwise(F.pmod(F.xxhash64("doc_id"), "few")).cast("int")
    against = F.sequence(F.lit(0), F.when(in_bulk, F.col("few")).otherwise(width) - 1)
    blocks = F.transform(against, lambda c: F.least(c, F.col("part")).cast("long") * width + F.greatest(c, F.col("part")))
    members = rows.join(cut(plan), "key").withColumn("part", part).withColumn("width", width).withColumn("block", F.explode(blocks))
    crossed = F.floor(F.col("block") / F.col("width")) != F.col("block") % F.col("width")
    return light.unionByName(members.select("key", "doc_id", "component", "part", "block", crossed.alias("crossed")))
