"""Quality rules with n-gram perplexity.

The model is a character n-gram model inside words, one for each language,
with interpolated modified Kneser-Ney smoothing. Spark counts the words of
every text, words first; estimation and values are joins and aggregations over
tables that grow with the input, keyed by the n-grams themselves. At most
``HEAD`` of the most frequent n-grams travel to the tasks with their values;
the others of a text are joined to theirs, so every n-gram has its own value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.common import text_slices
from motefield.session import written

ORDER = 5
#: N-grams whose values travel to the tasks, as 64-bit hashes, at most; the values of all others are joined.
HEAD = 1 << 20
#: Words a task counts, and slices it reads, before it passes its counts on.
COUNTED_WORDS, COUNTED_SLICES = 300_000, 16
#: Texts the model learns from: words at least, symbols a word and share of capitals at most.
LEARN_WORDS, LEARN_SYMBOLS, LEARN_CAPITALS = 50, 0.1, 0.3
#: Natural log of the probability of a character in a language of which nothing is known.
UNKNOWN = float(np.log(1e-6))
#: Symbols of the rules, and the white space between words.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: A band reaches this many interquartile ranges beyond the quartiles, and a factor of two in perplexity at least.
BAND_WIDTH = 4.0
BAND_LEAST = float(np.log(2.0))
_PAD = " "


def padded_grams(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all n-grams of the words, one row each, and the word each belongs to."""
    pad = _PAD * (order - 1)
    codes = np.frombuffer("".join(f"{pad}{w}{_PAD}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(np.r_[0, sizes[:-1] + order - 1]) if len(words) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), sizes) + np.repeat(starts, sizes) if len(words) else np.zeros(0, np.int64)
    return codes[at[:, None] + np.arange(order)], owner


def gram_hash(grams: np.ndarray, lang: str) -> np.ndarray:
    """64-bit hash of rows of code points, seeded by the language."""
    seed = np.uint64(1469598103934665603)
    with np.errstate(over="ignore"):
        for b in lang.encode():
            seed = (seed ^ np.uint64(b)) * np.uint64(1099511628211)
        h = np.full(len(grams), seed, np.uint64)
        for i in range(grams.shape[1]):
            h = (h ^ grams[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _words(text: str) -> list[bytes]:
    """Words as UTF-8; bytes split on exactly the ASCII white space of the rules."""
    return text.encode("utf-8", "replace").split()


def is_prose(text: str, n_words: int) -> bool:
    """Whether the model learns from a text."""
    if n_words < LEARN_WORDS or sum(text.count(c) for c in SYMBOLS) > LEARN_SYMBOLS * n_words:
        return False
    lower = text.lower()
    changed = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if len(lower) == len(text) else None
    return changed is None or int((changed != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)).sum()) <= LEARN_CAPITALS * len(text)


def all_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n, n_prose)`` over the words of all texts: how often, and how often in texts that look like prose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, bool], Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, prose), counts in words.items():
                if not counts:
                    continue
                grams, owner = padded_grams([w.decode() for w in counts], order)
                times = np.fromiter(counts.values(), np.int64, len(counts))[owner]
                _, first, same = np.unique(gram_hash(grams, ""), return_index=True, return_inverse=True)
                total = np.bincount(same, weights=times).astype(np.int64)
                text = np.ascontiguousarray(grams[first]).tobytes().decode("utf-32-le", "surrogatepass")
                columns = [pa.array([lang] * len(first)), pa.array([text[i : i + order] for i in range(0, len(text), order)]), pa.array(total), pa.array(total if prose else total * 0)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n", "n_prose"])
            words.clear()

        for i, part in enumerate(text_slices(batches), 1):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = _words(text)
                words.setdefault((lang, is_prose(text, len(found))), Counter()).update(found)
            if i % COUNTED_SLICES == 0 or sum(map(len, words.values())) > COUNTED_WORDS:
                yield from emit()
        yield from emit()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long, n_prose long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_prose").alias("n_prose"))


def learnt(grams: DataFrame) -> DataFrame:
    """The counted n-grams; a language without a text that looks like prose learns from all its texts."""
    most = written(grams.groupBy("lang").agg(F.max("n_prose").alias("most")), "languages")
    return grams.join(most, "lang").withColumn("n_prose", F.when(F.col("most") > 0, F.col("n_prose")).otherwise(F.col("n"))).drop("most")


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, gram, n)`` over the words of the texts that look like prose."""
    return all_grams(docs, order).filter("n_prose > 0").select("lang", "gram", F.col("n_prose").alias("n"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, k, weight, gram, value)``: the interpolated modified Kneser-Ney model as natural logs.

    ``weight`` false: the probability of the gram's last character after the
    others; true: the back-off weight of the gram as a context of order ``k``.
    Lower orders use continuation counts; each order and language has its own
    three discounts from the counts of counts (a half where they can't be
    estimated). The lowest order is interpolated with the uniform distribution
    over the characters seen in the language.
    """
    levels = {order: grams.select("lang", "gram", F.col("n").cast("double").alias("c"))}
    for k in range(order - 1, 0, -1):
        # distinct left extensions of the gram
        levels[k] = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    parts, prob = [], None
    for k in range(1, order + 1):
        rows = levels[k].withColumn("context", F.substring("gram", 1, k - 1))
        counts = rows.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("kinds"))
        y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))
        discounts = [
            F.least(F.lit(float(i)), F.greatest(F.lit(0.0), F.coalesce(F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5)))).alias(f"d{i}")
            for i in (1, 2, 3)
        ]
        rows = rows.join(counts.select("lang", "kinds", *discounts), "lang")
        rows = rows.withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        left = F.greatest(F.sum("d") / F.sum("c") / (F.max("kinds") if k == 1 else F.lit(1)), F.lit(1e-9))
        contexts = written(rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), left.alias("left")), f"contexts{k}")
        rows = rows.join(contexts, ["lang", "context"])
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if k > 1:
            lower = prob.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["lang", "suffix"])
        prob = written(rows.select("lang", "gram", (own + F.col("left") * (F.col("lower") if k > 1 else F.lit(1.0))).alias("p")), f"grams{k}")
        parts.append(prob.select("lang", F.lit(k).alias("k"), F.lit(False).alias("weight"), "gram", F.log("p").alias("value")))
        parts.append(contexts.select("lang", F.lit(k).alias("k"), F.lit(True).alias("weight"), F.col("context").alias("gram"), F.log("left").alias("value")))
    return reduce(DataFrame.unionAll, parts)


def gram_values(wanted: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of wanted n-grams with ``value``: the log probability of the last character.

    One that was not seen backs off to shorter contexts, step by step, by joins.
    """
    columns = wanted.columns
    rest, done = wanted.withColumn("value", F.lit(0.0)), []
    for k in range(order, 0, -1):
        level = model.filter(F.col("k") == k)
        own = level.filter(~F.col("weight")).select("lang", F.col("gram").alias("suffix"), F.col("value").alias("own"))
        left = level.filter("weight").select("lang", F.col("gram").alias("context"), F.col("value").alias("left"))
        tried = rest.withColumn("suffix", F.substring("gram", order - k + 1, k)).join(own, ["lang", "suffix"], "left")
        tried = written(tried.select(*columns, "value", "own"), f"tried{k}")
        done.append(tried.filter("own is not null").select(*columns, (F.col("value") + F.col("own")).alias("value")))
        unseen = tried.filter("own is null").withColumn("context", F.substring("gram", order - k + 1, k - 1)).join(left, ["lang", "context"], "left")
        rest = unseen.select(*columns, (F.col("value") + F.coalesce("left", F.lit(0.0 if k > 1 else UNKNOWN))).alias("value"))
    return reduce(DataFrame.unionAll, [*done, rest])


def head_table(values: DataFrame, head: int = HEAD) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and values of the most frequent n-grams, ``head`` at most: those of the upper steps of log frequency that fit."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = values.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("size")).toArrow().sort_by([("step", "descending")])
    fits = np.cumsum(sizes["size"].to_numpy()) <= head
    if not fits.any():
        return np.zeros(0, np.uint64), np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, langs = batch.column(1).to_pylist(), np.array(batch.column(0).to_pylist(), object)
            key = np.zeros(len(grams), np.uint64)
            for lang in set(langs):
                at = np.flatnonzero(langs == lang)
                text = "".join([grams[i] for i in at]).encode("utf-32-le", "surrogatepass")
                key[at] = gram_hash(np.frombuffer(text, np.uint32).reshape(len(at), -1), lang)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(2)], ["key", "value"])

    least = sizes["step"].to_numpy()[fits][-1]
    table = values.filter(step >= int(least)).select("lang", "gram", "value").mapInArrow(run, "key long, value double").toArrow()
    keys, value = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy()
    order = np.argsort(keys)
    return keys[order], value[order]


def _keys(points: np.ndarray, lang: str, k: int, weight: bool) -> np.ndarray:
    return gram_hash(points, f"{lang}/{k}/{weight}")


def score_table(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A model as sorted 64-bit hashes and their values, to look up by hand; ``quality`` joins instead, as this has no bound."""
    table = model.select("lang", "k", "weight", "gram", "value").toArrow().to_pylist()
    points = [np.frombuffer(r["gram"].encode("utf-32-le"), np.uint32).reshape(1, r["k"] - r["weight"]) for r in table]
    keys = np.array([_keys(p, r["lang"], r["k"], r["weight"])[0] for p, r in zip(points, table, strict=True)], np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["value"] for r in table])[order]


def gram_scores(grams: np.ndarray, lang: str, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log probability of the last character of each n-gram by such a table, backing off as ``gram_values`` does."""
    keys, values = table
    out = np.zeros(len(grams))
    if not len(keys):
        return out + UNKNOWN

    def find(points: np.ndarray, k: int, weight: bool) -> tuple[np.ndarray, np.ndarray]:
        key = _keys(points, lang, k, weight)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return keys[at] == key, values[at]

    order, rest = grams.shape[1], np.arange(len(grams))
    for k in range(order, 0, -1):
        seen, value = find(grams[rest, order - k :], k, False)
        out[rest[seen]] += value[seen]
        rest = rest[~seen]
        if not len(rest):
            break
        known, weight = find(grams[rest, order - k : order - 1], k, True)
        out[rest] += np.where(known, weight, 0.0 if k > 1 else UNKNOWN)
    return out


def text_rules(text: str, ids: dict[bytes, int] | None = None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated three-word windows."""
    words = _words(text)
    inside = len(text) - sum(text.count(c) for c in WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeated = 0
    if len(words) >= 4:
        ids = {} if ids is None else ids
        x = np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64)
        with np.errstate(over="ignore"):
            h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
        _, same, n = np.unique(h, return_inverse=True, return_counts=True)
        again = n[same] > 1
        mark = np.zeros(len(words), bool)
        for i in range(3):
            mark[i : i + len(again)] |= again
        repeated = int(mark.sum())
    return len(words), inside, symbols, len(lines) - len(set(lines)), repeated


_COLUMNS = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "prose", "cross_entropy"]


#: Word scores remembered by a task.
_CACHE = 400_000


def score_texts(docs: DataFrame, values: DataFrame, head: int = HEAD) -> DataFrame:
    """Counts of the rules and the cross-entropy (nats a character) of every text; null for a text without words.

    ``values`` holds ``(lang, gram, n, value)`` for every n-gram of the texts.
    Those that don't travel leave the task as a list and are joined to their values.
    """
    sent = docs.sparkSession.sparkContext.broadcast(head_table(values, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, value = sent.value
        known: dict[str, dict[bytes, float]] = {}
        others: dict[str, dict[bytes, list[str]]] = {}

        def learn(lang: str, words: list[bytes]) -> None:
            grams, owner = padded_grams([w.decode() for w in words])
            h = gram_hash(grams, lang)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            here = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            score = np.where(here, value[at], 0.0) if len(keys) else np.zeros(len(h))
            known[lang].update(zip(words, np.bincount(owner, weights=score, minlength=len(words)).tolist(), strict=True))
            for i in np.flatnonzero(~here).tolist():
                others[lang].setdefault(words[owner[i]], []).append(grams[i].tobytes().decode("utf-32-le", "surrogatepass"))

        for part in text_slices(batches, text=2):
            ids, langs, texts = (part.column(i).to_pylist() for i in range(3))
            split = [_words(t) for t in texts]
            if sum(map(len, known.values())) > _CACHE:
                known, others = {}, {}
            for lang in set(langs):
                seen = known.setdefault(lang, {})
                others.setdefault(lang, {})
                new = [w for w in dict.fromkeys(w for words, at in zip(split, langs, strict=True) if at == lang for w in words) if w not in seen]
                for start in range(0, len(new), 8192):
                    learn(lang, new[start : start + 8192])
            numbers: dict[bytes, int] = {}
            rows = []
            for i, lang, text, words in zip(ids, langs, texts, split, strict=True):
                n, inside, symbols, lines, repeated = text_rules(text, numbers)
                rest = [g for w in words if w in others[lang] for g in others[lang][w]]
                rows.append((i, lang, n, inside, symbols, lines, repeated, is_prose(text, n), float(sum(map(known[lang].__getitem__, words))), rest))
            types = [part.column(0).type, pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*_COLUMNS[:-1], "total", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{c} long" for c in _COLUMNS[2:-2]) + ", prose boolean, total double, rest array<string>"
    rows = written(docs.select("doc_id", "lang", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    each = rows.select("row", "lang", F.explode("rest").alias("gram")).join(values.select("lang", "gram", "value"), ["lang", "gram"])
    more = each.groupBy("row").agg(F.sum("value").alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    entropy = F.when(F.col("n_words") > 0, -total / (F.col("word_chars") + F.col("n_words")))
    return rows.join(more, "row", "left").withColumn("cross_entropy", entropy).select(*_COLUMNS)


def bands(scores: DataFrame, width: float = BAND_WIDTH, least: float = BAND_LEAST) -> DataFrame:
    """``(lang, lower, upper)`` of cross-entropy, from the quartiles of all texts that look like prose; of all texts with words where none does.

    Quartiles come from an exact histogram in steps of a thousandth.
    """
    every = scores.filter("cross_entropy is not null").groupBy("lang", F.round("cross_entropy", 3).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.count_if("prose").alias("n_prose"))
    any_prose = F.sum("n_prose").over(Window.partitionBy("lang")) > 0
    bins = every.withColumn("n", F.when(any_prose, F.col("n_prose")).otherwise(F.col("n"))).filter("n > 0")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("v")) / F.sum("n").over(Window.partitionBy("lang"))
    cut = bins.withColumn("share", upto).groupBy("lang").agg(*[F.min(F.when(F.col("share") >= q, F.col("v"))).alias(c) for q, c in ((0.25, "q1"), (0.75, "q3"))])
    reach = F.greatest((F.col("q3") - F.col("q1")) * width, F.lit(least))
    return cut.select("lang", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Rules and perplexity verdict of every row.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lang, perplexity``. A text fails the base
    rules below ``min_words`` words or with more than ``max_repeat`` of its
    words in repeated three-word windows. Otherwise it is kept while its
    perplexity lies inside the band of its language; a language without any
    prose has model and band from all its texts. A null text is empty and
    fails; a null language is a language of its own, shown as null. Repeated
    rows are counted and scored as often as they occur. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grams = written(all_grams(docs), "grams")
    model = kneser_ney(learnt(grams).filter("n_prose > 0").select("lang", "gram", F.col("n_prose").alias("n")))
    values = written(gram_values(grams.select("lang", "gram", "n"), model), "values")
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    scores = written(score_texts(docs, values).withColumn("base_failed", base), "scores")
    judged = scores.join(bands(scores), "lang", "left")
    inside = F.col("cross_entropy").between(F.col("lower"), F.col("upper"))
    return judged.select(
        "doc_id", *_COLUMNS[2:-2], "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.nullif(F.col("lang"), F.lit("")).alias("lang"), F.exp("cross_entropy").alias("perplexity"),
    )
