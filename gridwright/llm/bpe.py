"""Byte-level BPE ids for whole texts through the tokenizers library, with each word encoded once.

The pre-tokenizer of these vocabularies always starts a new token at a space that stands
before a non-space character. A text is therefore cut at such spaces, each distinct piece is
encoded by the library once per worker, and the ids are put together again by numpy. Texts
with other spacing are encoded whole by the library. Strings that the vocabulary file adds to
its model (``<|endoftext|>``) are found as the library finds them: pieces that hold one go to it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridwright.llm.words import claim, pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Letters, and all characters, whose classes are the same in every Unicode version.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LATIN = re.compile("[\\x21-\\x7e\u00c0-\u024f]+")
#: The pre-token classes of this kind of vocabulary, for pieces without white space.
_TOKENS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?[^\w\s]+(?:_+[^\w\s]*)*| ?_+(?:[^\w\s]+_*)*")
_ODD_SPACE = re.compile(r" (?!\S)| [\x1c-\x1f\x85]")
_PUNCTUATION = frozenset(".,")
#: Pieces kept by a worker: two generations of this many, so memory is bounded.
CACHE_PIECES = 400_000


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes are themselves, others follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.most = most

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: One with white space may lie across pieces: texts that hold it are not cut.
        self.added, self.spaced = added, [t for t in added if any(c.isspace() for c in t)]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, piece: str) -> bytes:
        """Ids of one pre-token, which needs no more cutting."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in tokens]).tobytes()

    def _cut(self, piece: str) -> bytes:
        """Ids of a piece that is not cached: by shorter pieces where the cut is certain."""
        body = piece[1:] if piece[:1] == " " else piece
        if any(t in piece for t in self.added):
            return self.whole(piece)
        if _LETTERS.fullmatch(body):
            return self._word(piece)
        if body[-1:] in _PUNCTUATION and _LETTERS.fullmatch(body[:-1]):
            return self.piece(piece[:-1]) + self.piece(body[-1])
        lines = piece.split("\n")
        if len(lines) > 1 and all(x and x.strip() == x for x in [body.split("\n", 1)[0], *lines[1:]]):
            return self.piece("\n").join(self.piece(x) for x in lines)
        if _LATIN.fullmatch(body):
            return b"".join(self._word(x) for x in _TOKENS.findall(piece))
        return self.whole(piece)

    def piece(self, piece: str) -> bytes:
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self._cut(piece)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order as uint32, offsets of n + 1 texts); a null text is empty."""

        def of(distinct: list[str], heads: list[str]) -> list[bytes]:
            known = self.young
            ids = [known.get(w) or self.piece(w) for w in map(" ".__add__, distinct)]
            return ids + [self.piece(h) if h else b"" for h in heads]

        return assemble(texts, of, self.odd, self.whole)

    def odd(self, text: str) -> bool:
        """Whether a text can't be cut at its spaces."""
        return bool(_ODD_SPACE.search(text)) or any(t in text for t in self.spaced)


def assemble(texts: pa.Array, of: Callable, odd: Callable, whole: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from the ids of their space-separated parts.

    ``of(parts, first parts)`` gives the ids of each distinct part that follows a space, then of
    each distinct part that begins a text. Texts for which ``odd`` holds go to ``whole``.
    """
    n = len(texts)
    texts = pc.fill_null(texts, "")
    parts = pc.split_pattern(texts, " ")
    rows = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + n + 1].astype(np.int64)
    values = parts.values.slice(rows[0], rows[-1] - rows[0])
    rows = rows - rows[0]
    words = values.dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = words.dictionary.to_pylist()
    # the first part of a text has no space before it: a second range of codes holds those
    first = code[rows[:-1]]
    heads = np.unique(first)
    code[rows[:-1]] = len(distinct) + np.searchsorted(heads, first)
    ids = of(distinct, [distinct[h] for h in heads])
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    pool = np.frombuffer(b"".join(ids), dtype="<u4")
    begin = np.cumsum(lengths) - lengths
    each = lengths[code]
    ends = np.concatenate([[0], np.cumsum(each)])
    shift = np.repeat(begin[code] - ends[:-1], each)
    shift += np.arange(len(shift))
    out, offsets = pool[shift], ends[rows]
    special = [i for i, t in enumerate(texts.to_pylist()) if t and odd(t)]
    if special:
        chunks, at, sizes = [], 0, np.diff(offsets)
        for i in special:
            chunks.append(out[at : offsets[i]])
            chunks.append(np.frombuffer(whole(texts[i].as_py()), dtype="<u4"))
            sizes[i] = len(chunks[-1])
            at = offsets[i + 1]
        chunks.append(out[at:])
        out, offsets = np.concatenate(chunks), np.concatenate([[0], np.cumsum(sizes)])
    return out, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = CACHE_PIECES) -> WordEncoder:
    """The worker's encoder of a vocabulary file, made once; it keeps up to twice ``most`` pieces."""
    claim("bpe", _encoders)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].most = most
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, text: str, size: int = 8 << 20, most: int = CACHE_PIECES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets) for ranges of about ``size`` bytes of text."""
    words = encoder(path, most)
    for batch in batches:
        for part in pieces(batch, text, size):
            yield part, *words.encode(part.column(part.schema.get_field_index(text)))
