"""Repeated word windows by prefix-partitioned suffix trees.

Suffixes of the word sequences of all documents begin at anchors: in each window of 20 words, the
place of the smallest hash among its ``GRAM``-word runs. Equal windows have equal anchors at equal
places. The first ``GRAM`` words of an anchored suffix are the prefix that splits suffixes into
groups. A prefix with more than ``GROUP`` suffixes is split window by window and made longer, the
more suffixes it has the longer (``LENGTHS``): to the right up to the window's end, then to the left
of the anchor, up to whole windows and runs of them, where a group needs only its smallest member.

A group is small enough for a worker's memory. There the suffixes, as words, are sorted to a tree
to the right of the anchors, and the words before the anchors, read backwards, to a second tree.
Suffixes below one node of depth d on the right and one node of depth 20 - d on the left share a
window of 20 words; all but the smallest are repeats. Words are compared as words; hashes only
choose anchors and groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.words import claim, mix, ngram_hashes, pieces, split_words, word_hashes, word_table
from gridwright.session import cut

WINDOW = 20
GRAM = 6
#: Suffixes of one prefix above which it is made longer.
GROUP = 1_500
#: Words of a prefix by its number of suffixes: up to GROUP times 1 and 2; the whole window above.
LENGTHS = ((1, GRAM), (2, 10))


def windows_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, position of its anchor, prefix hash there) of one document."""
    w = ngram_hashes(words, window)
    if not len(w):
        return w, np.zeros(0, np.int64), w
    grams = ngram_hashes(words, gram)
    span = window - gram + 1
    # leftmost minimum over every run of ``span`` grams, by doubling
    value, place = grams, np.arange(len(grams))
    have = 1
    while have < span:
        step = min(have, span - have)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        value = np.where(take, right, left)
        place = np.where(take, place[step:], place[: len(place) - step])
        have += step
    return w, place, value


def _prefixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``prefix, doc_id, n``: anchors of each document and how often each occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for batch in batches:
            for rows in pieces(batch, "text", 2 << 20):
                hashes, ends = word_hashes(rows.column(1))
                keys, ids, counts = [], [], []
                for key, a, b in zip(rows.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                    if b - a < window:
                        continue
                    _, place, value = windows_of(hashes[a:b], window, gram)
                    once = np.concatenate([[True], place[1:] != place[:-1]])
                    prefix, n = np.unique(value[once], return_counts=True)
                    keys.append(prefix)
                    counts.append(n)
                    ids.append(np.full(len(prefix), key, dtype=np.int64))
                if keys:
                    columns = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(counts)]
                    yield pa.record_batch([pa.array(c) for c in columns], names=["prefix", "doc_id", "n"])

    return docs.mapInArrow(run, "prefix long, doc_id long, n long")


def _letters(start: np.ndarray, anchor: np.ndarray, window: int) -> np.ndarray:
    """(windows, window) places of the words of each window in the order in which its prefix grows:
    from the anchor to the end of the window, then from before the anchor back to its start."""
    k, right = np.arange(window), (start + window - anchor)[:, None]
    return np.where(k < right, anchor[:, None] + k, anchor[:, None] - 1 - (k - right))


def _own_entries(lists: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted prefixes, their levels) of row ``k`` of a column of ``array<struct<prefix, level>>``."""
    entry = lists[k].values
    prefix, level = entry.field(0).to_numpy().view(np.uint64), entry.field(1).to_numpy()
    order = np.argsort(prefix)
    return prefix[order], level[order]


def _hits(words: np.ndarray, entries: tuple[np.ndarray, np.ndarray], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, prefix, level) of the runs of windows with one anchor whose prefix is
    among ``entries``."""
    w, place, value = windows_of(words, window, gram)
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(w)])
    stop = np.concatenate([begin[1:], [len(w)]])[: len(begin)]
    prefix, level = entries
    if not len(begin) or not len(prefix):
        return begin[:0], begin[:0], value[:0], np.zeros(0, np.int32)
    spot = np.searchsorted(prefix, value[begin])
    spot[spot == len(prefix)] = 0
    hit = prefix[spot] == value[begin]
    return begin[hit], stop[hit], prefix[spot[hit]], level[spot[hit]]


def _suffixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``prefix, doc_id, at, n, before, words`` of the suffixes whose prefix is in a document's list
    ``shared`` at one of ``LENGTHS``: the ``n`` windows from word ``at`` on, their words, and the
    number of words before the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for rows in pieces(batch, "text", 2 << 20):
                hashes, ends = word_hashes(rows.column(1))
                data, first, last, _ = word_table(rows.column(1))
                raw = data.tobytes()
                out: list[list[np.ndarray]] = [[] for _ in range(6)]
                for k, key in enumerate(rows.column(0).to_pylist()):
                    own = hashes[ends[k] : ends[k + 1]]
                    entries = _own_entries(rows.column(2), k)
                    begin, stop, prefix, level = _hits(own, entries, window, gram)
                    whole = level == 0
                    parts = [(begin[whole], (stop - begin)[whole], None, prefix[whole])]
                    place = windows_of(own, window, gram)[1] if len(begin) else begin
                    for lengthened in range(1, len(LENGTHS)):
                        runs = np.flatnonzero(level == lengthened)
                        if len(runs):
                            at = np.concatenate([np.arange(begin[r], stop[r]) for r in runs])
                            parts.append((at, np.ones(len(at), np.int64), LENGTHS[lengthened][1], None))
                    for at, n, length, prefix_ in parts:
                        if not len(at):
                            continue
                        before = place[at] - at
                        if length is not None:
                            longer = own[_letters(at, place[at], window)[:, :length]]
                            prefix_ = np.full(len(at), length, dtype=np.uint64)
                            for column in (before.astype(np.uint64), *longer.T):
                                prefix_ = mix(prefix_ * np.uint64(0x9E3779B97F4A7C15) + column)
                        for col, v in zip(out, (prefix_, np.full(len(at), key, np.int64), at, n, before, ends[k] + at), strict=True):
                            col.append(v)
                if out[0]:
                    prefix, doc, at, n, before, place = (np.concatenate(c) for c in out)
                    words = [raw[a:b] for a, b in zip(first[place].tolist(), last[place + n + window - 2].tolist(), strict=True)]
                    for a in range(0, len(doc), 8192):  # small batches: a reader holds one at a time
                        b = a + 8192
                        yield pa.record_batch(
                            [
                                pa.array(prefix[a:b].view(np.int64)),
                                pa.array(doc[a:b]),
                                *(pa.array(c[a:b].astype(np.int32)) for c in (at, n, before)),
                                pa.array(words[a:b], pa.binary()),
                            ],
                            names=["prefix", "doc_id", "at", "n", "before", "words"],
                        )

    return docs.mapInArrow(run, "prefix long, doc_id long, at int, n int, before int, words binary")


def _whole_runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``low, high, doc_id, places, n, windows`` of the suffixes whose prefix is in a document's list
    ``shared`` beyond ``LENGTHS``: a row for each distinct run of windows with one anchor.

    ``low, high`` are 128 bits of a cryptographic hash of all words of the run, ``windows`` those of
    each window: they stand for a prefix as long as the run or the window.
    """

    def digest(words: list[bytes]) -> bytes:
        return hashlib.blake2b(b" ".join(words), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for rows in pieces(batch, "text", 2 << 20):
                hashes, ends = word_hashes(rows.column(1))
                for k, (key, text) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                    begin, stop, _, level = _hits(hashes[ends[k] : ends[k + 1]], _own_entries(rows.column(2), k), window, gram)
                    runs = np.flatnonzero(level == len(LENGTHS))
                    if not len(runs):
                        continue
                    words, found, sizes, windows = split_words(text), {}, [], []
                    for a, b in zip(begin[runs].tolist(), stop[runs].tolist(), strict=True):
                        places = found.setdefault(digest(words[a : b - 1 + window]), [])
                        if not places:
                            sizes.append(b - a)
                            windows.append([digest(words[at : at + window]) for at in range(a, b)])
                        places.append(a)
                    pair = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                    columns = [pair[:, 0], pair[:, 1], np.full(len(found), key, np.int64)]
                    columns = [pa.array(c) for c in columns] + [pa.array(list(found.values()), pa.list_(pa.int32())), pa.array(sizes, pa.int32()), pa.array(windows, pa.list_(pa.binary()))]
                    yield pa.record_batch(columns, names=["low", "high", "doc_id", "places", "n", "windows"])

    return docs.mapInArrow(run, "low long, high long, doc_id long, places array<int>, n int, windows array<binary>")


def _hot_repeats(runs: DataFrame) -> DataFrame:
    """``doc_id, runs`` of the repeated windows among ``_whole_runs``.

    All runs of equal words but the first are repeats as they stand. The first ones, one of each
    wording, are compared window by window. Both find the smallest place by partial aggregation, so
    no task holds a hot group.
    """
    first = cut(
        runs.groupBy("low", "high").agg(
            F.min(F.struct("doc_id", F.col("places")[0].alias("at"), "n", "windows")).alias("first"), F.count("*").alias("docs"), F.max(F.size("places")).alias("most")
        )
    )
    several = first.where("docs > 1 OR most > 1").select("low", "high", F.col("first.doc_id").alias("own"), F.col("first.at").alias("at"))
    later = F.filter("places", lambda x: (F.col("doc_id") != F.col("own")) | (x != F.col("at")))
    copies = runs.drop("windows").join(several, ["low", "high"]).select("doc_id", F.transform(later, lambda x: F.struct(x.alias("at"), F.col("n"))).alias("runs"))
    each = first.select("first.doc_id", "first.at", F.posexplode("first.windows").alias("k", "digest")).select("doc_id", (F.col("at") + F.col("k")).alias("at"), "digest")
    low = cut(each.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("least"), F.count("*").alias("c")).where("c > 1").select("digest", "least"))
    apart = each.join(low, "digest").where((F.col("doc_id") != F.col("least.doc_id")) | (F.col("at") != F.col("least.at")))
    windows = apart.select("doc_id", F.array(F.struct("at", F.lit(1).alias("n"))).alias("runs"))
    return copies.where(F.size("runs") > 0).unionByName(windows)


def _hot_sources(runs: DataFrame) -> DataFrame:
    """``doc_id, at, first_doc_id, first_at`` of every repeated window among ``_whole_runs``."""
    each = runs.select("doc_id", F.explode("places").alias("place"), "windows").select("doc_id", "place", F.posexplode("windows").alias("k", "digest"))
    each = each.select("doc_id", (F.col("place") + F.col("k")).alias("at"), "digest")
    low = cut(each.groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("least")))
    apart = each.join(low, "digest").where((F.col("doc_id") != F.col("least.doc_id")) | (F.col("at") != F.col("least.at")))
    return apart.select("doc_id", "at", F.col("least.doc_id").alias("first_doc_id"), F.col("least.at").alias("first_at"))


def tree_nodes(letters: np.ndarray) -> np.ndarray:
    """(depth + 1, rows): number of the node at each depth above each leaf, in the tree of the rows
    of ``letters`` (32-bit, none negative).

    Rows are sorted; neighbours share the nodes up to the length of their common prefix.
    """
    n, depth = letters.shape
    order = np.argsort(np.ascontiguousarray(letters.astype(">u4")).view(f"S{4 * depth}").ravel(), kind="stable") if depth else np.arange(n)
    line = letters[order]
    common = np.logical_and.accumulate(line[1:] == line[:-1], axis=1).sum(axis=1)
    nodes = np.zeros((depth + 1, n), dtype=np.int64)
    for d in range(1, depth + 1):
        nodes[d, order[1:]] = np.cumsum(common < d)
    return nodes


def group_repeats(doc: np.ndarray, at: np.ndarray, n: np.ndarray, before: np.ndarray, words: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, window) marks and sources for one or more prefix groups, sorted by document and place.

    In the first, element (r, o) is true if the window that begins ``o`` words before the anchor of
    row r also begins earlier; in the second it is the row of its first place (-1: no such window).
    """
    lists = pc.ascii_split_whitespace(words.cast(pa.string()))
    code = lists.values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    edge = lists.offsets.to_numpy().astype(np.int64)
    code = np.append(code, 0)
    k, left = np.arange(window), int(before.max()) if len(before) else 0
    place = (edge[:-1] + before)[:, None] + k
    right = code[np.where(place < edge[1:, None], place, len(code) - 1)]
    place = (edge[:-1] + before)[:, None] - 1 - np.arange(left)
    nodes, back = tree_nodes(right), tree_nodes(code[np.where(place >= edge[:-1, None], place, len(code) - 1)])
    again, source = np.zeros((len(doc), left + 1), dtype=bool), np.full((len(doc), left + 1), -1, dtype=np.int64)
    anchor = at + before
    for o in range(left + 1):
        own = np.flatnonzero((o <= before) & (o > before - n))
        if len(own):
            node = nodes[window - o, own] * (len(doc) + 1) + back[o, own]
            _, first, which = np.unique(node, return_index=True, return_inverse=True)
            first = own[first][which]
            source[own, o] = first
            again[own, o] = (doc[own] != doc[first]) | (anchor[own] != anchor[first])
    return again, source


def _group_repeats(suffixes: DataFrame, window: int, sources: bool, most: int) -> DataFrame:
    """``doc_id, runs`` of repeated windows (the place of the first and their number), or ``doc_id,
    at, first_doc_id, first_at`` of each.

    Rows come sorted by prefix; whole groups are treated as soon as the next one begins. Of a group
    of more than ``most`` rows, rows that hold no first place are dropped on the way: rows come in
    the order of document and place, so first places stay first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        held: list[pa.RecordBatch] = []
        seen = 0  # rows of the held group that are reported already

        def treat(rows: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
            """The repeats among ``rows`` after the first ``seen``, and the rows of first places."""
            by = rows.combine_chunks()
            order = pc.sort_indices(by, sort_keys=[("doc_id", "ascending"), ("at", "ascending")]).to_numpy()
            doc, at, n, before = (by.column(c).to_numpy()[order].astype(np.int64) for c in ("doc_id", "at", "n", "before"))
            words = by.column("words").take(pa.array(order))
            words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
            again, source = group_repeats(doc, at, n, before, words, window)
            firsts = np.unique(source[(source >= 0) & ~again])
            again[order < seen] = False
            anchor = at + before
            if sources:
                row, o = np.nonzero(again)
                leaf = source[row, o]
                cols = [doc[row], (anchor[row] - o).astype(np.int32), doc[leaf], (anchor[leaf] - o).astype(np.int32)]
                return pa.record_batch([pa.array(c) for c in cols], names=["doc_id", "at", "first_doc_id", "first_at"]), np.sort(order[firsts])
            # runs of marks along the offsets; the largest offset of a run is its first window
            wide = np.pad(again, ((0, 0), (1, 1)))
            row, low = np.nonzero(wide[:, 1:] & ~wide[:, :-1])
            _, high = np.nonzero(wide[:, :-1] & ~wide[:, 1:])
            cols = [doc[row], (anchor[row] - (high - 1)).astype(np.int32), (high - low).astype(np.int32)]
            return pa.record_batch([pa.array(c) for c in cols], names=["doc_id", "at", "n"]), np.sort(order[firsts])

        for batch in batches:
            prefix = batch.column(0).to_numpy()
            if held and prefix[0] == prefix[-1] == held[-1].column(0)[-1].as_py():
                held.append(batch)
                if sum(b.num_rows for b in held) > most + seen:
                    rows = pa.Table.from_batches(held)
                    found, firsts = treat(rows)
                    yield found
                    held = rows.take(pa.array(firsts)).combine_chunks().to_batches()
                    seen = len(firsts)
                continue
            edge = int(np.searchsorted(prefix, prefix[-1]))
            done = pa.Table.from_batches([*held, batch.slice(0, edge)])
            if done.num_rows:
                yield treat(done)[0]
                seen = 0
            held = [batch.slice(edge)]
        if held:
            yield treat(pa.Table.from_batches(held))[0]

    ordered = suffixes.repartition("prefix").sortWithinPartitions("prefix", "doc_id", "at")
    schema = "doc_id long, at int, first_doc_id long, first_at int" if sources else "doc_id long, at int, n int"
    return ordered.select("prefix", "doc_id", "at", "n", "before", "words").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, sources: bool = False) -> DataFrame:
    """``doc_id, runs``: runs of windows that also start earlier, each the first one's word ``at``
    and their number ``n``.

    ``sources``: ``doc_id, at, first_doc_id, first_at``, one row per repeated window with the
    smallest place of its words.
    """
    lean = docs.select("doc_id", "text")
    prefixes = _prefixes(lean.where("doc_id IS NOT NULL"), window, gram)
    counts = prefixes.groupBy("prefix").agg(F.sum("n").alias("total")).where("total > 1")
    level = F.lit(len(LENGTHS))
    for k in reversed(range(len(LENGTHS))):
        level = F.when(F.col("total") <= LENGTHS[k][0] * group, k).otherwise(level)
    # cut first, so that a hot prefix is split in the join
    levels = cut(counts.select("prefix", level.cast("int").alias("level")))
    shared = cut(prefixes.join(levels, "prefix").groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "level")).alias("shared")))
    # outer joins throughout, so that every use of the texts has the same exchange
    rows = lean.join(shared.hint("shuffle_hash"), "doc_id", "left")
    found = _group_repeats(_suffixes(rows, window, gram), window, sources, 4 * group)
    if not sources:
        found = found.select("doc_id", F.array(F.struct("at", "n")).alias("runs"))
    if levels.where(F.col("level") == len(LENGTHS)).isEmpty():
        return found
    runs = _whole_runs(rows, window, gram)
    return found.unionByName(_hot_sources(runs) if sources else _hot_repeats(runs))


def maximal_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """``doc_id, start, length, first_doc_id, first_start``: each run of words, ``window`` or more,
    that stands at an earlier place too and cannot be made longer with that place.

    Places are counted in words; the earlier place is the first one in the order of ids. Windows
    whose first places follow each other, word by word, are one repeat. Nulls as in
    ``substring_dedup``.
    """
    lean = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = repeated_windows(lean, window, gram, group, sources=True).withColumn("shift", F.col("first_at") - F.col("at"))
    line = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "first_doc_id", "shift").orderBy("at"))
    runs = rows.withColumn("line", line).groupBy("doc_id", "first_doc_id", "shift", "line")
    out = runs.agg(F.min("at").alias("start"), (F.count("*") + window - 1).alias("length"), F.min("first_at").alias("first_start"))
    return out.select("doc_id", "start", "length", "first_doc_id", "first_start")


def removal_spans(windows: DataFrame) -> DataFrame:
    """``doc_id, starts``: the runs of repeated windows of a document."""
    return windows.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("starts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", with_text: bool = False, gram: int = GRAM, group: int = GROUP, carry: list[str] = (), as_is: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row, ``with_text`` also ``spans``
    (start and length in words of each maximal removed run) and ``text`` (kept words joined by
    one space; the text as it is, if it loses none and ``as_is`` is set); then the columns of ``docs`` named in ``carry``, as ``carry_0, carry_1, ...``.

    A word goes if a window of ``window`` words covers it whose words also start earlier: at a
    smaller id, or earlier in the same document. Windows are judged on the input. A null text
    has no words; texts shorter than the window keep all. Rows with a null id are never compared
    and keep all. Ids are expected to be unique; a row that comes twice is kept twice, as neither
    starts earlier. An empty table gives no rows; other columns are ignored.

    Texts are shuffled once by id (the exchange is reused for the removal); counting of prefixes
    is pre-aggregated and joined with adaptive skew handling; only suffixes whose prefix occurs
    twice are shipped. A very long text is one row and is read in one piece.
    """
    two = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    starts = removal_spans(repeated_windows(docs.select(*two), window, gram, group))
    rows = docs.select(*two, *[F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(carry)])
    return _cut_out(rows.join(starts.hint("shuffle_hash"), "doc_id", "left"), window, with_text, [f.name for f in rows.schema[2:]], as_is)


def _cut_out(rows: DataFrame, window: int, with_text: bool, carry: list[str], as_is: bool) -> DataFrame:
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", spans array<struct<start:int,length:int>>, text string" * with_text
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substring")
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            lists = batch.column(2)
            for k, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = split_words(text)
                n, spans = len(words), []
                if lists[k].is_valid:
                    at, runs = (lists[k].values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                    fits = at + runs + window - 1 <= n
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, at[fits], 1)
                    np.add.at(cover, (at + runs + window - 1)[fits], -1)
                    gone = np.cumsum(cover[:n]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    if with_text:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                        spans = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                kept = b" ".join(words)
                for col, v in zip(out, (key, n, n - len(words), hashlib.sha256(kept).hexdigest(), spans, (text if as_is and n == len(words) else kept.decode("utf-8", "replace")) if with_text else None), strict=True):
                    col.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays += [pa.array(out[4], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(out[5], pa.string())]
                names += ["spans", "text"]
            yield pa.record_batch(arrays + batch.columns[3:], names=names + carry)

    return rows.select("doc_id", "text", "starts", *carry).mapInArrow(run, schema)
