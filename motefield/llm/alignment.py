"""Alignment of the tokens of two tokenizers by interval coalescing.

Tokens of a byte-level BPE (A) and of a SentencePiece BPE (B) are byte
intervals of one text. All intervals are sorted by start; a running maximum of
their ends tells where a group closes: at a start that reaches it. Overlaps of
A and B tokens are expanded within. Both tokenizers cut before a space or a
newline that follows a character that is no white space, so a text is a row of
independent chunks, and a task aligns each distinct chunk once, all new chunks
of a slice in one set of arrays.

How often an id pair is linked in the corpus is counted on Spark. The most
frequent pairs, ``HEAD`` at most, travel to the tasks with their counts; the
others leave a task as pairs and are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.common import text_slices
from motefield.llm.pieces import MARK, WORDS_AT_ONCE, PieceCoder
from motefield.session import written

#: Pairs whose counts travel to the tasks, at most (17 bytes each).
HEAD = 1 << 20
#: Distinct chunks and their characters remembered by a task.
CACHE_CHUNKS, CACHE_CHARS = 500_000, 24_000_000
#: Chunks that are encoded by one set of arrays.
_SET = 4 * WORDS_AT_ONCE
#: Unicode white space, and all of it but the space and the newline.
_WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_SPACE = "".join(map(chr, _WHITE))
_OTHER = _SPACE.replace(" ", "").replace("\n", "")


def byte_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones are themselves, the others come after 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Aligner:
    """Both tokenizers, and the lengths in bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = PieceCoder(b_path)
        table = byte_table()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else b""
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b.surface], np.int64)
        self.ranked = self._as_ranks(a_path, vocabulary)
        # With a token for every byte both spell any chunk, but for a mark in the text, which B reads as a space.
        every = {bytes([b]) for b in range(256)}
        self.spells = every <= set(self.a_bytes) and every <= {self.b.surface[i] for i in self.b.byte_id.tolist()}
        inside = re.compile(f"[^{_SPACE}][ \n]")
        cuts = not any(inside.search(p.decode("utf-8", "replace")) for p in self.b.surface)
        self.chunk = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:[{_OTHER}][{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+" if cuts else ".+", re.DOTALL)

    def _as_ranks(self, path: str, vocabulary: dict[str, int]) -> tiktoken.Encoding | None:
        """The same encoder as a table of ranks, which is several times faster, if the merges of the file come in the order of their ids."""
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, splits = content["model"], content.get("pre_tokenizer") or {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [vocabulary.get("".join(p), -1) for p in pairs]
        special = {t["content"] for t in content.get("added_tokens", [])}
        singles = sorted(i for entry, i in vocabulary.items() if len(entry) == 1)
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space") and content.get("normalizer") is None
        if not plain or model.get("ignore_merges") or len(singles) != 256 or any(j <= i for i, j in zip([singles[-1], *ids], ids, strict=False)):
            return None
        ranks = {self.a_bytes[i]: i for entry, i in vocabulary.items() if entry not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def chunks(self, text: str | None) -> list[str]:
        return self.chunk.findall(" " + text) if text else []

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each chunk."""
        if self.ranked is not None:
            a = list(map(self.ranked.encode_ordinary, chunks))
        else:
            a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        marked = [c.replace(" ", MARK) for c in chunks]
        b = [ids for start in range(0, len(marked), _SET) for ids in self.b.encode_words(marked[start : start + _SET])]
        return a, b

    def whole(self, chunk: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both spell the chunk."""
        if self.spells:
            return MARK not in chunk
        raw = chunk.encode("utf-8", "replace")
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b.surface[i] for i in b])


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def coalesce(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, which cover the same bytes."""
    ends = np.r_[np.cumsum(a_len), np.cumsum(b_len)]
    starts = ends - np.r_[a_len, b_len]
    order = np.lexsort((np.arange(len(starts)) >= len(a_len), starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(np.r_[True, starts[order][1:] >= reach[:-1]]) - 1 if len(starts) else 0
    return group[: len(a_len)], group[len(a_len) :]


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B tokens whose byte ranges overlap, by A, then B."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    first = np.searchsorted(b_end, a_end - a_len, "right")
    n = np.searchsorted(b_end - b_len, a_end, "left") - first
    return np.repeat(np.arange(len(a_len)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Chunks:
    """Alignments of the distinct chunks seen so far, by number."""

    def __init__(self, code: Aligner, counted: bool = False):
        self.code, self.counted = code, counted
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        #: Rows of n_a, n_b, n_groups, n_links, spelt; and the id pairs of all links, one chunk after the other.
        self.stats, self.pairs = np.zeros((0, 5), np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.number) > CACHE_CHUNKS or self.chars > CACHE_CHARS

    def learn(self, new: list[str]) -> None:
        """Encode and align chunks that are not yet known."""
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        ids_a, ids_b = self.code.encode(new)
        spelt = np.array([self.code.whole(c, a, b) for c, a, b in zip(new, ids_a, ids_b, strict=True)])
        if not spelt.all():
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, spelt.tolist(), strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = np.array(list(map(len, ids_a))), np.array(list(map(len, ids_b)))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        a_len, b_len = self.code.a_len[a], self.code.b_len[b]
        group_a, group_b = coalesce(a_len, b_len)
        at, bt = overlaps(a_len, b_len)
        owner = np.repeat(np.arange(len(new)), n_a)
        last = np.r_[np.flatnonzero(np.diff(group_a)), len(group_a) - 1] if len(group_a) else np.zeros(0, np.int64)
        n_groups, n_links = np.bincount(owner[last], minlength=len(new)), np.bincount(owner[at], minlength=len(new))
        self.stats = np.r_[self.stats, np.stack([n_a, n_b, n_groups, n_links, spelt], axis=1)]
        self.pairs = np.r_[self.pairs, a[at] << 32 | b[bt]]
        if not self.counted:
            cut_a, cut_b = np.searchsorted(group_a, np.arange(n_groups.sum() + 1)).tolist(), np.searchsorted(group_b, np.arange(n_groups.sum() + 1)).tolist()
            text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
            each = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:], strict=False)]
            ends = np.cumsum(n_groups).tolist()
            self.groups.extend(";".join(each[i:j]) for i, j in zip([0, *ends], ends, strict=False))

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of all texts, and where each text ends; a text that the tokens don't spell has none."""
        split = [self.code.chunks(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.number)
        if new:
            self.learn(list(new))
        flat = np.array(list(map(self.number.__getitem__, chain.from_iterable(split))), np.int64)
        sizes = np.array(list(map(len, split)), np.int64)
        if len(flat) and not self.stats[flat, 4].all():
            owner = np.repeat(np.arange(len(split)), sizes)
            good = np.bincount(owner, weights=self.stats[flat, 4] == 0, minlength=len(split)) == 0
            flat, sizes = flat[good[owner]], np.where(good, sizes, 0)
        return flat, np.cumsum(sizes)


def pair_counts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``(pair, n, best)``: links of every id pair in the corpus (``a << 32 | b``), and whether no A id has more with that B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks(aligner(a_path, b_path), counted=True)
        times = np.zeros(0, np.int64)

        def emit() -> pa.RecordBatch:
            pairs, same = np.unique(cache.pairs, return_inverse=True)
            n = np.bincount(same, weights=np.repeat(np.r_[times, np.zeros(len(cache.stats) - len(times), np.int64)], cache.stats[:, 3]), minlength=len(pairs))
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(pairs[some]), pa.array(n[some].astype(np.int64))], ["pair", "n"])

        for part in text_slices(batches, text=0):
            flat, _ = cache.numbers(part.column(0).to_pylist())
            found = np.bincount(flat, minlength=len(cache.stats))
            found[: len(times)] += times
            times = found
            if cache.full():
                yield emit()
                cache, times = Chunks(cache.code, counted=True), np.zeros(0, np.int64)
        yield emit()

    found = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(found.withColumn("b", F.expr("pair & 4294967295L")), "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def head_counts(counts: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Pair, count and best flag of the most frequent pairs, ``head`` at most, sorted by pair; and whether these are all pairs."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("size")).toArrow().sort_by([("step", "descending")])
    fits = np.cumsum(sizes["size"].to_numpy()) <= head
    if not fits.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), not len(fits)
    table = counts.filter(step >= int(sizes["step"].to_numpy()[fits][-1])).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    return table["pair"].to_numpy()[order], table["n"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order], bool(fits.all())


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.r_[0, np.cumsum(values)][ends]])


def aligned_groups(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, groups)``: the groups of every whole text as ``a1,a2|b1;a3|b2,b3`` with ids in order; empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks(aligner(a_path, b_path))
        for part in text_slices(batches):
            if cache.full():
                cache = Chunks(cache.code)
            flat, ends = cache.numbers(part.column(1).to_pylist())
            texts = [";".join(map(cache.groups.__getitem__, flat[a:b].tolist())) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "groups"])

    chosen = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, groups string")


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_tokens(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row.

    A encodes a space and the text, B the text, to which it adds the space
    itself; special strings are plain text. Tokens of A and B whose byte ranges
    overlap are linked. The count of an id pair is the number of its links in
    the whole table: ``count_sum`` adds it up over the links of the row, and
    ``n_best`` counts the links whose pair no other pair of the same B id
    exceeds, ties included. ``groups_sha256`` is the lowercase hex digest of
    ``aligned_groups``. A text that is null, empty, or not spelt by the tokens
    of both has no tokens: zeros, and an empty digest. Repeated rows count and
    are returned as often as they occur. Other columns are left out.
    """
    counts = written(pair_counts(df, a_path, b_path, text_col), "counts")
    *known, complete = head_counts(counts, head)
    sent = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        cache = Chunks(aligner(a_path, b_path))
        # For each chunk: links that are best, sum of counts, and links whose pairs are not here.
        scores = np.zeros((0, 3), np.int64)
        for part in text_slices(batches):
            if cache.full():
                cache, scores = Chunks(cache.code), np.zeros((0, 3), np.int64)
            flat, ends = cache.numbers(part.column(1).to_pylist())
            links = cache.stats[len(scores) :, 3]
            first = cache.stats[: len(scores), 3].sum()
            new = cache.pairs[first:]
            at = np.minimum(np.searchsorted(pair, new), max(len(pair) - 1, 0))
            here = pair[at] == new if len(pair) else np.zeros(len(new), bool)
            each = np.stack([here & best[at], np.where(here, n[at], 0), ~here], axis=1) if len(pair) else np.stack([here, here, ~here], axis=1)
            upto = np.r_[np.zeros((1, 3), np.int64), np.cumsum(each.astype(np.int64), axis=0)]
            scores = np.r_[scores, np.diff(upto[np.r_[0, np.cumsum(links)]], axis=0)]
            rest, times = [[]] * part.num_rows, [[]] * part.num_rows
            starts = np.r_[0, ends[:-1]]
            if len(flat) and scores[flat, 2].any():
                place = np.r_[0, np.cumsum(cache.stats[:, 3])]
                for row, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    open_ = [i for i in flat[a:b].tolist() if scores[i, 2]]
                    if open_:
                        mine = np.concatenate([cache.pairs[place[i] : place[i + 1]] for i in open_])
                        where = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
                        rest[row], times[row] = np.unique(mine[pair[where] != mine] if len(pair) else mine, return_counts=True)
            sha = [hashlib.sha256(";".join(map(cache.groups.__getitem__, flat[a:b].tolist())).encode()).hexdigest() if b > a else "" for a, b in zip(starts, ends, strict=True)]
            sums = [_per_text(cache.stats[flat, i], ends) for i in range(4)] + [_per_text(scores[flat, i], ends) for i in range(2)]
            columns = [part.column(0), *[pa.array(x.astype(np.int64)) for x in sums], pa.array(sha, pa.string()), pa.array(rest, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_COLUMNS, "groups_sha256", "rest", "times"])

    chosen = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", groups_sha256 string, rest array<long>, times array<long>"
    rows = chosen.mapInArrow(run, schema)
    if complete:
        return rows.drop("rest", "times")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    each = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), "x.times")
    more = each.join(counts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("more_best"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return rows.join(more, "row", "left").withColumns(added).select("doc_id", *_COLUMNS, "groups_sha256")
