"""Importance resampling and token alignment against plain versions on whole texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motefield.llm import alignment, importance
from motefield.llm.common import looked_up

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def plain_draw(docs, target):
    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    whole_s, whole_t = s.total() + 10_000, t.total() + 10_000
    out = []
    for (i, _), (words, f) in zip(docs, found, strict=True):
        gains = [math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted([tuple(r[:5]) for r in out], key=repr)


def drawn(spark, docs, target, **options):
    df = spark.createDataFrame([(*d, 0, "k") for d in docs], "doc_id long, text string, row long, lines string")
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    rows = importance.draw(importance.importance_weights(df, aim, **options)).collect()
    return sorted([tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows], key=repr)


def test_draw_equals_a_plain_one(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "Beta", "été", "x1", "日本", "O'Neil", "a-b", "ÀB", "7", "--", "zeta"]
    line = [" ".join(rng.choice(vocabulary, rng.integers(1, 9))) for _ in range(25)]
    docs = [(i, "\n".join(rng.choice([*line, "", " -- ", "only here " + str(i)], rng.integers(1, 14)))) for i in range(80)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (200, None), (201, ""), (202, "--\n\n.."), (203, "a\nb\n\nc"), (204, "word " * 5000), (205, "x" * 50_000)]
    target = ["alpha beta\nalpha Beta zeta", None, "", "x1 7"]
    want = plain_draw(docs, target)
    assert drawn(spark, docs, target) == want
    assert sum(r[4] is not None for r in want) > 5
    assert drawn(spark, docs, []) == plain_draw(docs, [])
    assert drawn(spark, [], target) == []


def test_common_and_rare_keys_are_looked_up(spark):
    keys = [None, "hot"] * 300 + [f"k{i}" for i in range(1500)] + ["unknown"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    table = spark.createDataFrame([("hot", 300, 1)] + [(f"k{i}", 1, i) for i in range(1500)], "key string, times int, v int")
    got = {r["i"]: r["v"] for r in looked_up(rows, table, "key", "times").collect()}
    assert got == {i: 1 if k == "hot" else int(k[1:]) if k and k != "unknown" else None for i, k in enumerate(keys)}
    docs = [(i, "a common line of text\n" + "\n".join(f"own words {i} {j}" for j in range(40))) for i in range(40)]
    assert drawn(spark, docs, ["own words common"]) == plain_draw(docs, ["own words common"])


def test_drawn_rows(spark, odd):
    aim = spark.createDataFrame([(1, "of the word")], "item_id long, text string")
    draws = importance.draw(importance.importance_weights(odd, aim), percent=100)
    assert draws.count() == odd.count() and {r["doc_id"] for r in draws.filter("rank is not null").collect()} == {1, 2, 7}
    assert importance.drawn_rows(odd, draws).columns == odd.columns and importance.drawn_rows(odd, draws).count() == 4


def plain_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = alignment.byte_table()
    rows = []
    for text in texts:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(table[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(ba) != raw or b"".join(bb) != raw:
            rows.append(([], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, links, lo, la, lb = [], [], 0, 0, 0
        for cut in sorted(set(ea) & set(eb)):
            na, nb = ea.index(cut) + 1, eb.index(cut) + 1
            groups.append(f"{','.join(map(str, ia[la:na]))}|{','.join(map(str, ib[lb:nb]))}")
            for i in range(la, na):
                for j in range(lb, nb):
                    if max(ea[i] - len(ba[i]), eb[j] - len(bb[j])) < min(ea[i], eb[j]):
                        links.append((ia[i], ib[j]))
            la, lb, lo = na, nb, cut
        rows.append((ia, ib, groups, links))
    count = Counter(x for r in rows for x in r[3])
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [
        (len(ia), len(ib), len(g), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for ia, ib, g, x in rows
    ]


ODD = [
    None, "", " ", "\n", "  a", "plain words here", "<|endoftext|> and <s> </s> <0x41>", "a ▁ b", "▁", "tab\there  two", "line\n next\n\n  third;\r\n}\r\n", "é日本語🙂 mixed 12345", "x\x1cy\x85 z　w ᠎ q",
    "don't we'll I'm", "trailing   ", "a\xa0 b", "\x00\x01", "=" * 300, "word " * 3000, "y" * 20_000, "plain words here",
]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0])
def test_alignment_equals_a_plain_one(spark, head):
    df = spark.createDataFrame([(i, t, "r", 0) for i, t in enumerate(ODD)], "doc_id long, text string, rest string, times long")
    rows = sorted(alignment.align_tokens(df, A, B, head=head).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in rows] == plain_alignment(ODD)
    groups = {r["doc_id"]: r["groups"] for r in alignment.aligned_groups(df, A, B).collect()}
    assert all((hashlib.sha256(groups[r["doc_id"]].encode()).hexdigest() if groups[r["doc_id"]] else "") == r["groups_sha256"] for r in rows)


def test_alignment_of_odd_tables(spark, odd, none):
    rows = alignment.align_tokens(odd, A, B).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count() and all((r["n_a"] == 0) == (not texts[r["doc_id"]]) for r in rows)
    assert alignment.align_tokens(none, A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "\r", "\t", "\r\n", "é", "日本", "🙂", "'s", "\x1c", "\x85", "　", ";", "}", "▁", "23", "\x0b"]) | st.text(max_size=4), max_size=25).map("".join))
def test_chunks_align_as_whole_texts(text):
    cache = alignment.Chunks(alignment.aligner(A, B))
    flat, ends = cache.numbers([text])
    got = cache.stats[flat, :4].sum(axis=0).tolist()
    digest = hashlib.sha256(";".join([cache.groups[i] for i in flat]).encode()).hexdigest() if len(flat) else ""
    want = plain_alignment([text])[0]
    assert (*got, digest) == (*want[:4], want[6])
