"""SentencePiece encoding for merge-type vocabularies with an agenda of adjacent symbol pairs.

A text is normalised to U+2581 for spaces with one in front, then cut where no merge can reach:
between two characters that never stand side by side inside a vocabulary piece. Each distinct
part is merged once per worker by an agenda (a heap of adjacent pairs ordered by score, then by
position), and every newly met word is compared with the sentencepiece library, a batch of words
at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.bpe import assemble
from gridwright.llm.words import claim
from gridwright.llm.words import pieces as row_ranges

MARK = "▁"
#: Words kept by a worker: two generations of this many.
CACHE_WORDS = 300_000


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.ids, self.cost = {}, {}
        for k in range(size):
            if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k) or lib.is_unused(k)):
                piece = lib.id_to_piece(k)
                self.ids[piece], self.cost[piece] = k, -lib.get_score(k)
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if lib.unk_id() in self.bytes:
            self.bytes = []
        self.together = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if any(x[1] == MARK and x[0] != MARK for x in self.together):
            raise ValueError("pieces of this vocabulary reach over a space")
        probe = lib.encode("  a  b ", out_type=str)
        if "".join(probe) != f"{MARK * 3}a{MARK * 2}b{MARK}" or lib.encode("ﬁÅ", out_type=str)[0][:1] != MARK:
            raise ValueError("this vocabulary changes spaces")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.corrected = 0

    def agenda(self, text: str) -> list[str]:
        """The pieces of a text: the best-scored adjacent pair is merged until none is left."""
        symbols = list(text)
        n = len(symbols)
        cost = self.cost
        heap = [(cost[p], k, p) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in cost]
        if not heap:
            return symbols
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, left, piece = heappop(heap)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != piece:
                continue  # one of the two was merged in the meantime
            symbols[left], symbols[right] = piece, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (p := piece + symbols[nxt]) in cost:
                    heappush(heap, (cost[p], left, p))
            prev = before[left]
            if prev >= 0 and (p := symbols[prev] + piece) in cost:
                heappush(heap, (cost[p], prev, p))
        return [s for s in symbols if s]

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            out: list[int] = []
            for s in self.agenda(part):
                known = self.ids.get(s)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in s.encode())
                else:
                    out.append(self.library.unk_id())
            found = array("I", out).tobytes()
            if len(self.parts) >= CACHE_WORDS:
                self.parts = {}
            self.parts[part] = found
        return found

    def merge(self, text: str) -> bytes:
        """Ids of a normalised text."""
        together, at, out = self.together, 0, []
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in together:
                out.append(self._part(text[at:k]))
                at = k
        out.append(self._part(text[at:]))
        return b"".join(out)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that follow a space (or begin a text); new ones are checked."""
        fresh = [w for w in words if w not in self.young]
        missing = []
        for w in fresh:
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                self.young[w] = self.merge(MARK + w.replace(" ", MARK))
                missing.append(w)
        words_ids = [self.young[w] for w in words]
        if missing:
            say = self.library.encode([w for w in missing if w], num_threads=1)
            wrong = {w: ids for w, ids in zip([w for w in missing if w], say, strict=True) if self.young[w] != array("I", ids).tobytes()}
            if wrong:
                self.corrected += len(wrong)
                for w, ids in wrong.items():
                    self.young[w] = array("I", ids).tobytes()
                words_ids = [self.young[w] for w in words]
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        return words_ids

    def whole(self, text: str) -> bytes:
        """Ids of a text with other than single spaces between words."""
        body = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        out, run = [], ""
        for k, word in enumerate(body):
            run += MARK
            if word or k == len(body) - 1:
                out.append(self.merge(run + word))
                run = ""
        mine = b"".join(out)
        library = array("I", self.library.encode(text)).tobytes()
        self.corrected += mine != library
        return library if mine != library else mine

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        def of(distinct: list[str], heads: list[str]) -> list[bytes]:
            ids = self.words(distinct)
            at = dict(zip(distinct, ids, strict=True))
            return ids + [at[h] if h else b"" for h in heads]

        return assemble(texts, of, lambda t: t[0] == " " or "  " in t or MARK in t, self.whole)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    claim("pieces", _encoders)
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected`` of every row, and with
    ``with_ids`` the ids and the decoded text.

    Ids have the begin and end ids around them and are decoded by the library. ``n_corrected``
    counts words of the row's batch for which the library disagreed with the agenda and was
    followed (0 in all tests). A null text is empty: begin and end ids only. Repeated rows give
    repeated results, an empty table none; other columns are ignored. One map over the rows, no
    shuffle; a worker holds about 4 MB of text, its ids and two bounded word tables.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        begin, end = np.uint32(own.library.bos_id()), np.uint32(own.library.eos_id())
        for batch in batches:
            for rows in row_ranges(batch, "text"):
                was = own.corrected
                ids, offs = own.encode(rows.column(1))
                n = rows.num_rows
                full = [np.concatenate([[begin], ids[offs[k] : offs[k + 1]], [end]]).astype("<u4") for k in range(n)]
                decoded = [own.library.decode(x.tolist()) for x in full]
                columns = [
                    rows.column(0),
                    pa.array([len(x) for x in full], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in full]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([own.corrected - was] * n, pa.int64()),
                ]
                if with_ids:
                    columns += [pa.array([x.astype(np.int32) for x in full], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected", "ids", "decoded"][: len(columns)])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
