"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The model file gives the pieces and their scores. Pieces never cross from a
character to a following word mark, so a text is a row of independent words
and each distinct word of a slice is encoded once. All words of a call lie in
flat numpy arrays of symbols. A round finds the pair of best rank in each word
(segmented minimum), merges its occurrences leftmost first, and compacts the
arrays; a word without a known pair is done.

Merging all occurrences of a pair at once equals the library's one-at-a-time
order unless the new piece can be part of a piece of better or equal rank. Such
pieces are known from the vocabulary. For them only occurrences too far apart
to meet are merged in the same round.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from motefield.llm.common import map_texts

MARK = "▁"
#: Distinct words remembered by a Python worker.
CACHE_WORDS = 800_000
#: Words encoded by one set of arrays, which then stay in the processor's cache.
WORDS_AT_ONCE = 8192
_NONE = np.iinfo(np.int64).max


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.end = lib.eos_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.surface: list[bytes] = [b""] * n
        self.decimal = [str(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        ids: dict[str, int] = {}
        for i, piece in enumerate(pieces):
            if lib.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.surface[i] = bytes([value])
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                ids[piece] = i
                self.surface[i] = piece.replace(MARK, " ").encode()
        several = [p for p in ids if len(p) > 1]
        self.char_id = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        if any(self.char_id[ord(c)] < 0 for p in several for c in p):
            raise ValueError("a piece holds a character that is no piece")
        scores = {p: lib.get_score(i) for p, i in ids.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(n, _NONE, np.int64)
        shared: dict[float, int] = {}
        for p in several:
            self.rank[ids[p]] = order[scores[p]]
            shared[scores[p]] = shared.get(scores[p], 0) + 1
        self.unsafe = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        for p in several:
            self.unsafe[ids[p]] |= shared[scores[p]] > 1
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is None or b is None:
                    continue
                pairs[a << 32 | b] = ids[p]
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and scores[part] <= scores[p]:
                        self.unsafe[ids[part]] = True
        self._index(pairs)
        self.apart = 2 * max(map(len, several), default=1)
        self.length = np.array([len(p) for p in pieces], np.int64)
        # A character of no longer piece always stands alone; a mark after another character always starts a word.
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in several)
        alone = "\n" if not any("\n" in p for p in several) else ""
        self.word = re.compile(".+" if inner else f"\n|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _index(self, pairs: dict[int, int]) -> None:
        """Open addressing for the pairs of symbols that make a piece; at most a third of the slots are taken."""
        key, piece = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.mask = (1 << int(3 * len(key) + 1).bit_length()) - 1
        self.slot_key, self.slot_piece = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.slot_key[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.slot_key[slot[won]], self.slot_piece[slot[won]] = key[won], piece[won]
            rest = np.ones(len(key), bool)
            rest[won] = False
            key, piece, slot = key[rest], piece[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * -7046029254386353131 >> 40) & self.mask

    def _lookup(self, key: np.ndarray) -> np.ndarray:
        """Piece made by each pair of symbols, or -1."""
        slot = self._slot(key)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_piece[slot], -1)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.slot_key[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_piece[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, without an end id."""
        if not words:
            return []
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.char_id[code]
        symbol = np.where(symbol < 0, -1 - code, symbol)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank, merged = self._pairs(symbol, owner)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.repeat(best, sizes)
            over = best == _NONE
            if over.any():
                done.append((owner[over], symbol[over]))
                keep = ~over
                symbol, owner, rank, merged, best = symbol[keep], owner[keep], rank[keep], merged[keep], best[keep]
                if not len(symbol):
                    break
            at = self._chosen(np.flatnonzero(rank == best), merged, owner, symbol)
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        owner = np.concatenate([o for o, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        flat, cut = symbol.tolist(), [0, *ends.tolist()]
        parts = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        for w in np.unique(owner[symbol < 0]).tolist():
            parts[w] = [i for s in parts[w] for i in (self.byte_id[list(chr(-1 - s).encode("utf-8", "replace"))].tolist() if s < 0 else [s])]
        return parts

    def _pairs(self, symbol: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that starts at each symbol."""
        rank, merged = np.full(len(symbol), _NONE, np.int64), np.full(len(symbol), -1, np.int64)
        at = np.flatnonzero((owner[1:] == owner[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0))
        if len(at):
            piece = self._lookup(symbol[at] << 32 | symbol[at + 1])
            hit = piece >= 0
            at, piece = at[hit], piece[hit]
            merged[at], rank[at] = piece, self.rank[piece]
        return rank, merged

    def _chosen(self, at: np.ndarray, merged: np.ndarray, owner: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of the best pairs (positions in order), those to merge in this round."""
        first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        # Leftmost first: of a run of overlapping pairs every other one.
        run = np.r_[True, np.diff(at) != 1] | first
        place = np.arange(len(at))
        since = place - np.maximum.accumulate(np.where(run, place, 0))
        take = since % 2 == 0
        careful = np.logical_or.reduceat(self.unsafe[merged[at]], np.flatnonzero(first))
        careful = np.repeat(careful, np.diff(np.r_[np.flatnonzero(first), len(at)]))
        if careful.any():
            char = np.cumsum(np.where(symbol < 0, 1, self.length[np.maximum(symbol, 0)]))
            far = np.r_[True, np.diff(char[at]) >= self.apart]
            take &= ~careful | first | far
        return at[take]

    def words(self, text: str) -> list[str]:
        """Words of a text with the leading mark the model adds; none for an empty text."""
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: list[str]) -> None:
        """Encode and decode words that are not yet known."""
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for start in range(0, len(new), WORDS_AT_ONCE):
            part = new[start : start + WORDS_AT_ONCE]
            for w, found in zip(part, self.encode_words(part), strict=True):
                self.known[w] = (len(found), " ".join([self.decimal[i] for i in found]), b"".join([self.surface[i] for i in found]))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        words = self.words(text)
        self.learn(words)
        return [int(i) for w in words for i in self.known[w][1].split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space the encoder put in front is taken off again."""
        raw = b"".join([self.surface[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row: whole text, an end id last, no sampling.

    A null or empty text gives the end id alone. Repeated rows are encoded as
    often as they occur. Other columns of the input are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(model)
        ids = [code.encode(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_texts(df, {"doc_id": id_col, "text": text_col}, run, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the text of every row's ids; null ids give an empty text."""

    def run(batches):
        code = coder(model)
        for batch in batches:
            texts = [code.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode, and hash both without shipping the ids.

    Digests are lowercase hex of the decimal ids joined by a space and of the
    decoded text in UTF-8. Nulls, empty texts and repeats as in ``encode_documents``.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = coder(model)
        split = [code.words(t) for t in batch.column(1).to_pylist()]
        code.learn([w for words in split for w in words])
        known, end = code.known, str(code.end)
        count, ids, text = [], [], []
        for words in split:
            rows = [known[w] for w in words]
            count.append(sum([r[0] for r in rows]) + 1)
            ids.append(hashlib.sha256(" ".join([*[r[1] for r in rows], end]).encode()).hexdigest())
            text.append(hashlib.sha256(b"".join([r[2] for r in rows]).removeprefix(b" ")).hexdigest())
        columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids), pa.array(text)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
