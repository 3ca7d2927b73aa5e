"""Word and shingle hashing over whole Arrow text columns, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its hash takes eight bytes at a
time through a mixing bijection, so words of one length up to eight bytes never collide and longer
ones do so by chance alone (2**-64); very long words go through BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SEED = np.uint64(0x5851F42D4C957F2D)
#: Bytes of a word that are hashed by columns; longer words are hashed one by one.
_COLUMNS = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

_tables: dict[str, dict] = {}


def claim(owner: str, table: dict | None = None) -> None:
    """Called by an operator when its work begins in a worker process, which may have served
    another before: the lookup tables of the others are dropped, and ``table`` is noted."""
    for other in [o for o in _tables if o != owner]:
        _tables.pop(other).clear()
    if table is not None:
        _tables[owner] = table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 rows) of a string column; a null row has no bytes."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, word offsets of n + 1 rows) of a text column."""
    data, offs = buffers(texts)
    n = len(data)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    opened = solid.copy()
    opened[1:] &= ~solid[:-1] | first[1:n]
    closed = solid
    closed = solid.copy()
    closed[:-1] &= ~solid[1:] | first[1:n]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    return data, starts, ends, np.searchsorted(starts, offs)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, word offsets of n + 1 rows).

    ``lower`` makes A-Z equal to a-z.
    """
    data, starts, ends, rows = word_table(texts)
    data = np.concatenate([_LOWER[data] if lower else data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * np.uint64(_BASE) + _SEED)
    left = np.flatnonzero(sizes <= _COLUMNS)
    at = 0
    while len(left):
        rest = sizes[left] - at
        chunk = eight[starts[left] + at] & _MASKS[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ chunk) * np.uint64(_BASE))
        at += 8
        left = left[rest > 8]
    for k in np.flatnonzero(sizes > _COLUMNS).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out, rows


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` hashes; element i covers words i to i + n - 1."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out += words[k : k + size]
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``size`` bytes of text, one row at least."""
    lengths = np.diff(buffers(batch.column(batch.schema.get_field_index(column)))[1])
    total, at = np.concatenate([[0], np.cumsum(lengths)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def split_words(text: str | None) -> list[bytes]:
    """The words of a text; ``bytes.split`` cuts at exactly the six white-space bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
