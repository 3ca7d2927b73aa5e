"""Token counts that follow edits: a segment tree of pre-token blocks per document.

A document is cut before spaces that stand before a non-space character. Byte-level
pre-tokenizers always start a token there, whatever stands to the left, so blocks can be counted
one by one and their sums are exact. A tree keeps characters and tokens of every subtree. An
edit re-encodes the blocks it touches; if the changed region no longer begins with such a space,
the block before it is taken in as boundary context. Only the paths from changed blocks to the
root are updated.

Trees are kept as a table (``count_trees``): the text with the characters and tokens of each block.
``apply_edits`` takes such a table up again, without encoding what the edits leave alone, and gives
the next one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.bpe import _ODD_SPACE, WordEncoder, encoder
from gridwright.llm.words import pieces
from gridwright.session import fresh_path

BLOCK = 32
_SAFE = re.compile(r" (?=[^\s\x1c-\x1f\x85])")
#: Personal data that the registered query masks.
MASKS = [("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[A-Za-z]{2,}", "<EMAIL>"), ("[0-9]{6,}", "<NUMBER>")]


class _Counts(dict):
    """Tokens of a word after a space; forgets everything at a bounded size."""

    def __init__(self, words: WordEncoder, most: int = 500_000):
        super().__init__()
        self.words, self.most = words, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = len(self.words.piece(" " + word)) // 4
        return n


class CountTree:
    """Characters and tokens of the blocks of one text."""

    def __init__(self, blocks: list[str], tokens: list[int], count):
        self.blocks, self.count = blocks, count
        self.width = 1 << max(0, len(blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (b, n) in enumerate(zip(blocks, tokens, strict=True)):
            self.chars[self.width + k], self.tokens[self.width + k] = len(b), n
        for k in range(self.width - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.encoded_chars = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.blocks)

    def _find(self, at: int) -> tuple[int, int]:
        """(block that holds character ``at``, its place inside); the end belongs to the last."""
        if at >= self.chars[1]:
            k = len(self.blocks) - 1
            while k > 0 and not self.blocks[k]:
                k -= 1
            return k, len(self.blocks[k]) - max(0, self.chars[1] - at)
        k = 1
        while k < self.width:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.width, at

    def _set(self, block: int, text: str, tokens: int) -> None:
        self.blocks[block] = text
        k = self.width + block
        d, e = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += d
            self.tokens[k] += e
            k //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replaces characters ``start`` to ``end`` of the present text."""
        first, inside = self._find(start)
        last, rest = (first, inside) if end <= start else self._find(end - 1)
        cut = rest + 1 if end > start else rest
        text = self.blocks[first][:inside] + replacement
        text += self.blocks[last][cut:]
        # a region that does not begin with a safe space joins the block before it
        before = first
        while before > 0 and not _SAFE.match(text):
            before -= 1
            text = self.blocks[before] + text
        self.encoded_chars += len(text)
        for k in range(before + 1, last + 1):
            if self.blocks[k]:
                self._set(k, "", 0)
        self._set(before, text, self.count(text))


def tree_of(text: str, words: WordEncoder, counts: _Counts, block: int = BLOCK) -> CountTree:
    count = lambda t: len(words.whole(t)) // 4 if t else 0
    if not text:
        return CountTree([""], [0], count)
    if _ODD_SPACE.search(text):
        cuts = [0, *(m.start() for m in _SAFE.finditer(text) if m.start())]
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        sizes = [len(words.piece(p)) // 4 for p in parts]
        blocks = ["".join(parts[k : k + block]) for k in range(0, len(parts), block)]
    else:
        parts = text.split(" ")
        sizes = list(map(counts.__getitem__, parts))
        sizes[0] = len(words.piece(parts[0])) // 4 if parts[0] else 0
        blocks = [" " * (k > 0) + " ".join(parts[k : k + block]) for k in range(0, len(parts), block)]
    sums = np.add.reduceat(np.array(sizes, dtype=np.int64), np.arange(0, len(sizes), block)).tolist()
    return CountTree(blocks, sums, count)


def tree_from(text: str, block_chars: list[int], block_tokens: list[int], count) -> CountTree:
    """The tree of a stored row; nothing is encoded. ``count`` gives the tokens of an edited block."""
    if sum(block_chars) != len(text):
        raise ValueError("the blocks of a tree must cover its text")
    ends = np.cumsum(block_chars).tolist()
    return CountTree([text[b - n : b] for b, n in zip(ends, block_chars, strict=True)], block_tokens, count)


def with_masks(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """Adds ``masks``: the patterns of ``MASKS`` that occur in the text, so that rows without any stay cheap."""
    return docs.withColumn("masks", F.array_compact(F.array(*[F.when(F.regexp_like(F.coalesce(F.col(text), F.lit("")), F.lit(p)), F.lit(i)) for i, (p, _) in enumerate(MASKS)])))


def gather_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Joins a table ``doc_id, start, end, replacement`` to trees as the column ``edits``.

    Edits of a document are offsets into its text and are bounded by its length. Documents without
    edits, and rows with a null id, get null.
    """
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    return trees.join(lists, "doc_id", "left")


def _told(edits: list) -> list[tuple[int, int, str]]:
    """Edits in order: without a start they are left out, as is one that begins before the end of
    another that was taken; an end before the start, or none, makes an insertion."""
    out, done = [], 0
    for start, end, new in sorted(((max(0, s), s if e is None else e, r or "") for s, e, r in edits if s is not None)):
        if start >= done:
            out.append((start, max(start, end), new))
            done = max(start, end)
    return out


def count_trees(docs: DataFrame, vocabulary: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, text, block_chars, block_tokens, n_tokens`` of every row, to be kept as a table.

    A null text is empty and has one block without tokens; repeated rows and rows with a null id
    have trees of their own; an empty table gives no rows; other columns are ignored, whatever their
    names. A worker holds about 4 MB of text, or one longer text, at a time.
    """
    schema = "doc_id long, text string, block_chars array<long>, block_tokens array<long>, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        counts = _Counts(words)
        for batch in batches:
            for rows in pieces(batch, "text"):
                chars, tokens, totals = [], [], []
                for text in rows.column(1).to_pylist():
                    tree = tree_of(text or "", words, counts, block)
                    leaves = slice(tree.width, tree.width + len(tree.blocks))
                    chars.append(tree.chars[leaves])
                    tokens.append(tree.tokens[leaves])
                    totals.append(tree.total)
                lists = pa.list_(pa.int64())
                yield pa.record_batch([rows.column(0), rows.column(1), pa.array(chars, lists), pa.array(tokens, lists), pa.array(totals, pa.int64())], names=["doc_id", "text", "block_chars", "block_tokens", "n_tokens"])

    return _lean(docs).mapInArrow(run, schema)


def _lean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


COUNTS = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_blocks", "encoded_chars", "n_chars_edited"]


def apply_edits(trees: DataFrame, vocabulary: str, edits: DataFrame | None = None, with_tree: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_edits, n_blocks, encoded_chars, n_chars_edited`` per row
    of a table of ``count_trees``; ``with_tree`` adds ``text, block_chars, block_tokens`` of the edited
    text, which is such a table again.

    ``edits``: ``doc_id, start, end, replacement``; without them the patterns of ``MASKS`` are the
    edits. Of overlapping edits the first stays; one without a start is left out; a null replacement
    is empty; an edit past the end appends. Only the blocks that edits touch are encoded, as
    ``encoded_chars`` tells. Rows are taken one by one, so a null or repeated id has its own result
    (and all rows of a repeated id the same edits).
    """
    lists = "block_chars array<long>, block_tokens array<long>"
    schema = ", ".join(f"{n} long" for n in COUNTS) + f", text string, {lists}" * with_tree
    patterns = [(re.compile(p, re.ASCII), r) for p, r in MASKS]
    given = edits is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        count = lambda t: len(words.whole(t)) // 4 if t else 0
        for batch in batches:
            for rows in pieces(batch, "text"):
                out: list[list] = [[] for _ in range(len(COUNTS) + 3 * with_tree)]
                for key, text, chars, tokens, own in zip(*(rows.column(k).to_pylist() for k in range(5)), strict=True):
                    text = text or ""
                    if given:
                        todo = _told([(e["start"], e["end"], e["replacement"]) for e in own or []])
                    else:
                        todo = _told([(m.start(), m.end(), patterns[i][1]) for i in own for m in patterns[i][0].finditer(text)])
                    if not todo and not with_tree:  # as it was
                        values = [key, sum(tokens), sum(tokens), 0, len(chars), 0, len(text)]
                    else:
                        tree = tree_from(text, chars, tokens, count)
                        before = tree.total
                        for start, end, new in reversed(todo):  # from the end, so offsets stay true
                            tree.edit(start, end, new)
                        values = [key, before, tree.total, len(todo), len(tree.blocks), tree.encoded_chars, tree.chars[1]]
                        if with_tree:
                            leaves = slice(tree.width, tree.width + len(tree.blocks))
                            values += [tree.text, tree.chars[leaves], tree.tokens[leaves]]
                    for col, v in zip(out, values, strict=True):
                        col.append(v)
                arrays = [pa.array(c, pa.int64()) for c in out[:7]]
                if with_tree:
                    arrays += [pa.array(out[7], pa.string()), *(pa.array(c, pa.list_(pa.int64())) for c in out[8:])]
                yield pa.record_batch(arrays, names=[*COUNTS, *["text", "block_chars", "block_tokens"] * with_tree])

    rows = trees.select("doc_id", "text", "block_chars", "block_tokens")
    rows = gather_edits(rows, edits) if given else with_masks(rows)
    return rows.select("doc_id", "text", "block_chars", "block_tokens", "edits" if given else "masks").mapInArrow(run, schema)


def edited_counts(docs: DataFrame, vocabulary: str, edits: DataFrame | None = None, with_tree: bool = False) -> DataFrame:
    """Trees of ``docs``, written to the shared folder and taken up again by ``apply_edits``."""
    path = fresh_path(docs.sparkSession, "trees")
    count_trees(docs, vocabulary).write.parquet(path)
    return apply_edits(docs.sparkSession.read.parquet(path), vocabulary, edits, with_tree)
