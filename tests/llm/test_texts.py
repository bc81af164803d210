"""Packing, line templates, pieces, token counts and quality rules."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motefield.llm import linededup, packing, pieces, quality, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= v) - v) for v, c in zip(lengths, counts, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, buckets):
    lengths, counts = list(histogram), list(histogram.values())
    ends, pad = packing.boundaries(lengths, counts, buckets)
    top = max(lengths)
    best = min(padding(lengths, counts, [*c, top]) for k in range(buckets) for c in itertools.combinations(lengths, k))
    assert ends == sorted(set(ends)) and len(ends) <= buckets and ends[-1] == top
    assert pad == best == padding(lengths, counts, ends)


def test_pack_places_every_token_once(odd, none):
    rows = packing.pack(odd, packing.token_count(F.col("text")), max_len=100, buckets=4, token_budget=1000).collect()
    want = {r["doc_id"]: r["n"] for r in odd.select("doc_id", packing.token_count(F.col("text")).alias("n")).collect()}
    got = Counter()
    for r in rows:
        assert r["start"] == 100 * r["segment"] and r["n_tokens"] <= r["bucket_len"]
        got[r["doc_id"]] += r["n_tokens"]
    assert got == Counter({**want, 2: 2 * want[2]})
    assert len({(r["bucket_len"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    for (end, _), n in Counter((r["bucket_len"], r["batch"]) for r in rows).items():
        assert n * end <= 1000
    assert packing.pack(none, packing.token_count(F.col("text"))).collect() == []


def test_lines_of_templates(spark, odd, none):
    long = "a shared notice of twelve words that stands in many of the texts"
    rows = [
        (3, f"{long}\nown line of three number one here", "en"), (1, f"first words\n{long}", "en"), (2, f"{long}\n{long}\nso it is", "en"),
        (4, "request 17 took 5 ms", "en"), (5, "request 99 took 12 ms", "en"), (6, "request 3 took 1 ms\nother", "en"),
        (7, long.replace("texts", "books"), "en"), (8, "short", "en"), (9, "short", "en"), (10, "short", "en"), (11, None, "en"),
    ]
    got = {r["doc_id"]: r for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, lines string"), min_docs=3).collect()}
    assert got[1]["text"] == f"first words\n{long}" and got[1]["dropped_lines"] == []
    assert got[2]["text"] == "so it is" and got[2]["dropped_lines"] == [0, 1]
    assert got[3]["text"] == "own line of three number one here"
    assert [got[i]["text"] for i in (4, 5, 6)] == ["request 17 took 5 ms", "", "other"]
    assert got[7]["text"] == ""  # one word off: the same template
    assert all(got[i]["text"] == "short" for i in (8, 9, 10)) and got[11]["text"] is None and got[11]["n_lines"] == 0
    whole = linededup.drop_recurring_lines(odd)
    assert whole.count() == odd.count() and set(odd.columns) <= set(whole.columns)
    assert linededup.drop_recurring_lines(none).collect() == []


def test_long_lines_of_two_documents_and_short_ones_of_three(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(55))
    changed = passage.replace("wordcl", "another")
    rows = [
        (1, f"{passage}\nShare this article"), (2, f"own\n{passage}\nShare this article"), (3, "Share this article\nPage 3"), (4, "Page 4\nPage 4\nfive words in two documents"),
        (5, "Page 5\nfive words in two documents\nonly here and nowhere else as a line of more than ten tokens"), (6, changed),
    ]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "own", 3: "Page 3", 4: rows[3][1], 5: rows[4][1], 6: ""}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "aa", "the", "ing", " ", "  ", "\n", "é", "日本", "🙂", "\x00", "▁", "<s>", "</s>", "<0x41>", "23", "==", "----", "\t", "tion", "er"]) | st.text(max_size=6), max_size=40).map("".join))
def test_pieces_equal_the_library(text):
    code = pieces.coder(MODEL)
    lib = test_pieces_equal_the_library.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=MODEL))
    text = text.encode("utf-8", "ignore").decode()
    ids = code.encode(text)
    assert ids == lib.encode(text, add_eos=True) and code.decode(ids) == lib.decode(ids)


def test_long_words_in_pieces(library):
    code, rng = pieces.coder(MODEL), random.Random(3)
    for text in ["a" * 3000, "ning" * 800, "0123456789" * 300, "".join(rng.choice("abcdeinghstro") for _ in range(6000))]:
        assert code.encode(text) == library.encode(text, add_eos=True)


def test_piece_documents(odd, none, library):
    texts = odd.filter("doc_id in (1, 3, 4, 5)")
    ids = pieces.encode_documents(texts, MODEL)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(ids, MODEL).collect()}
    want = {r["doc_id"]: r["text"] or "" for r in texts.collect()}
    assert back == want
    digests = {r["doc_id"]: r for r in pieces.round_trip_digests(odd, MODEL).collect()}
    assert pieces.round_trip_digests(odd, MODEL).count() == odd.count() and pieces.round_trip_digests(none, MODEL).collect() == []
    for i, text in want.items():
        ids = library.encode(text, add_eos=True)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_length_histogram(odd, none):
    encode = tokens.encoding(RANKS).encode_ordinary
    lengths = sorted(len(encode(r["text"] or "")) for r in odd.collect())
    sums = tokens.suffix_sums(tokens.length_histogram(tokens.encoded_lengths(odd, RANKS)))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for v, r in rows.items():
        assert r["n_docs"] == lengths.count(v) and r["docs_at_least"] == sum(x >= v for x in lengths)
        assert r["tokens_at_least"] == sum(x for x in lengths if x >= v) and r["truncated_total"] == sum(min(x, v) for x in lengths)
        assert r["share_at_most"] == pytest.approx(sum(x <= v for x in lengths) / len(lengths))
    limits = [0, 1, 100, 512, 10**6]
    for r in tokens.totals_at(sums, limits).collect():
        assert r["n_docs"] == len(lengths) and r["truncated_total"] == sum(min(x, r["context"]) for x in lengths)
        assert r["n_over"] == sum(x >= r["context"] for x in lengths)
    for r in tokens.quantile_lengths(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == lengths[math.ceil(r["share"] * len(lengths)) - 1]
    empty = tokens.suffix_sums(tokens.length_histogram(tokens.encoded_lengths(none, RANKS)))
    assert empty.collect() == [] and tokens.totals_at(empty, [5]).collect() == []


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney, written with dictionaries."""
    top = Counter()
    for text in texts:
        for w in text.split():
            padded = " " * (order - 1) + w + " "
            top.update(padded[i : i + order] for i in range(len(w) + 1))
    level = {order: top}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])

    def discount(k, c):
        n = Counter(level[k].values())
        if not n[1] + 2 * n[2]:
            return 0.5
        i = min(c, 3)
        return min(i, max(0.0, i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i])) if n[i] else 0.5

    by_context = {k: defaultdict(list) for k in level}
    for k, grams in level.items():
        for g, c in grams.items():
            by_context[k][g[:-1]].append(c)

    def prob(g):
        k = len(g)
        counts = by_context[k].get(g[:-1])
        lower = prob(g[1:]) if k > 1 else 1 / len(level[1])
        if not counts:
            return lower
        left = max(sum(discount(k, c) for c in counts) / sum(counts), 1e-9)
        c = level[k].get(g, 0)
        return (max(c - discount(k, c), 0.0) / sum(counts) if c else 0.0) + left * lower

    return prob


def test_kneser_ney_equals_a_plain_one(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice(["th", "e", "an", "in", "er", "o"]) for _ in range(rng.randint(1, 4))) for _ in range(70)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    table = quality.score_table(quality.kneser_ney(quality.count_grams(df)))
    prob = plain_model(texts, quality.ORDER)
    for word in ["then", "anin", "o", "zebra", "th", "eze"]:
        grams, _ = quality.padded_grams([word])
        got = quality.gram_scores(grams, "en", table)
        padded = " " * (quality.ORDER - 1) + word + " "
        want = [math.log(prob(padded[i : i + quality.ORDER])) for i in range(len(word) + 1)]
        assert got.tolist() == pytest.approx(want, abs=2e-4)


def test_scores_of_all_words_are_exact(spark):
    """Unseen n-grams back off, and n-grams beyond the head are joined; once all shared a table of a fixed number of slots."""
    assert not hasattr(quality, "SLOTS")
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["th", "e", "an", "in", "er", "o"]) for _ in range(rng.randint(1, 4))) for _ in range(70)) for _ in range(12)]
    other = "QXJ zebra then %% é日本 anin " + "x" * 300
    rows = [(i, t, "en") for i, t in enumerate([*texts, other])] + [(99, "then o", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = quality.written(quality.all_grams(df), "grams")
    model = quality.kneser_ney(quality.count_grams(df))
    values = quality.written(quality.gram_values(grams.select("lang", "gram", "n"), model), "values")
    prob = plain_model(texts, quality.ORDER)
    pad = " " * (quality.ORDER - 1)
    want = {w: sum(math.log(prob(f"{pad}{w} "[i : i + quality.ORDER])) for i in range(len(w) + 1)) for t in [*texts, other] for w in t.split()}
    got = {r["gram"]: r["value"] for r in values.collect() if r["lang"] == "en"}
    assert got == pytest.approx({g: math.log(prob(g)) for t in [*texts, other] for w in t.split() for g in [f"{pad}{w} "[i : i + quality.ORDER] for i in range(len(w) + 1)]}, rel=1e-9)
    for head in (0, 20, quality.HEAD):
        for r in quality.score_texts(df, values, head).collect():
            if r["lang"] == "en":
                found = rows[r["doc_id"]][1].split()
                assert r["cross_entropy"] == pytest.approx(-sum(want[w] for w in found) / sum(len(w) + 1 for w in found), rel=1e-9)


def test_a_language_without_prose_has_a_band(spark):
    """Such a language once kept whatever passed the base rules."""
    rng = random.Random(7)
    code = [" ".join("".join(rng.choice(["get", "set", "node", "list", "key"]) for _ in range(3)) + "%" for _ in range(90)) for _ in range(60)]
    junk = " ".join("".join(rng.choice("QXZJKVWYéñøßþ") for _ in range(rng.randint(3, 9))) + "%" for _ in range(120))
    df = spark.createDataFrame([(i, t, "code") for i, t in enumerate([*code, junk])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert not any(r["base_failed"] for r in got.values() if r["doc_id"] == 60) and not got[60]["kept"]
    judged = [r for r in got.values() if r["doc_id"] < 60 and not r["base_failed"]]
    assert judged and all(r["kept"] for r in judged)


def plain_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é|", "#*", "\xa0", "\x85", "\x1c", " ", "\n", "\t", "\x0b", "x y z\n"]), max_size=60).map("".join))
def test_rules_equal_plain_ones(text):
    assert quality.text_rules(text) == plain_rules(text)


def test_quality_of_odd_rows_and_junk(spark, odd, none):
    rng = random.Random(2)

    def prose(n):
        return " ".join("".join(rng.choice(["the", "an", "ing", "er", "on", "st", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(i, prose(80), "en") for i in range(60)] + [(100, prose(80).upper(), "en"), (101, " ".join(w + "%%%" for w in prose(80).split()), "en"), (102, prose(20), "en"), (103, prose(80), None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in (100, 101, 102)) and got[102]["base_failed"] and got[103]["kept"]
    assert got[103]["lang"] is None
    whole = quality.quality(odd).collect()
    assert len(whole) == odd.count()
    for r in whole:
        if r["doc_id"] in (3, 4, 5):
            assert r["n_words"] == 0 and r["base_failed"] and not r["kept"] and r["perplexity"] is None
    assert quality.quality(none).collect() == []
