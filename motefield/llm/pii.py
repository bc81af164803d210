"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers found in the texts. How strongly a term reveals an entity is estimated
from co-occurrence in the corpus: with ``p`` the share of documents, the
pointwise mutual information ``log2 p(e, t) / (p(e) p(t))`` over the
information ``-log2 p(e)`` of the entity. It is 1 if the term occurs with the
entity only. Every occurrence of such a term in a text that holds the entity is
generalised above one threshold and removed above the next. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.spans import disjoint, replaced, row_key, with_matches
from motefield.session import only_row, written

# The patterns of the contract, anchored and possessive so that long runs take linear time; the matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_NEEDS = {"email": "@", "phone": "+", "ip": "."}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?!\p{N})"
#: Texts in which a term and an entity meet at least; what stands in one text only says nothing about co-occurrence.
SUPPORT = 2
GENERALIZE, REMOVE = 0.7, 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), weigh), F.lit(0), lambda a, x: a + x) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _named(spans: Column, kind: str) -> Column:
    entity = (lambda v: F.lower(v)) if kind == "email" else (lambda v: v) if kind == "ip" else _digits
    return F.transform(
        F.filter(spans, lambda s: _VALID[kind](s["value"])),
        lambda s: F.struct(s["start"], F.lit(KINDS.index(kind)).alias("kind"), s["end"], F.concat(F.lit(f"{kind}:"), entity(s["value"])).alias("entity")),
    )


def find_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` reduced to ``__id, __sum, doc_id, text, entities``; entities are sorted by start, then kind."""
    rows = row_key(df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "text")
    found = with_matches(rows, F.col("text"), PATTERNS, _NEEDS)
    return found.select("__id", "__sum", "doc_id", "text", F.array_sort(F.concat(*[_named(F.col(k), k) for k in PATTERNS])).alias("entities"))


def masked(text: Column) -> Column:
    """The text with the letters and digits of e-mail addresses as ``0``, so that no term is found in or across one. The other kinds hold no letters."""
    gaps, hits = F.split(text, PATTERNS["email"], -1), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0))
    joined = F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.regexp_replace(h, "[A-Za-z0-9]", "0"), F.lit("")))), "")
    return F.when(text.contains("@"), joined).otherwise(text)


def with_terms(entities: DataFrame) -> DataFrame:
    """``__id, __sum, doc_id, entities, words``: for texts that hold an entity every occurrence of a term, found where the text lies."""
    holding = entities.withColumn("masked", F.when(F.size("entities") > 0, masked(F.col("text"))))
    words = F.transform("words", lambda t: F.struct(F.lower(t["value"]).alias("term"), t["start"], t["end"]))
    return with_matches(holding, F.col("masked"), {"words": TERM}).select("__id", "__sum", "doc_id", "entities", words.alias("words"))


def _classes(members: DataFrame, name: str, size: str, own: Column, support: int) -> DataFrame:
    """``(name, size, class)`` of what occurs in ``support`` texts at least: members of the same texts and size are one class.

    What stands in the same texts meets everything equally often, so a list of
    thousands of addresses, or the private words of a group of copies, count once.
    """
    row = F.xxhash64("__id", "__sum")
    grouped = members.groupBy(name).agg(F.count(F.lit(1)).alias("texts"), F.bit_xor(row).alias("a"), F.bit_xor(F.xxhash64(row, F.lit(1))).alias("b"), own.alias(size))
    return grouped.filter(F.col("texts") >= support).select(name, size, F.xxhash64("texts", "a", "b", size).alias("class"))


def revealing_terms(found: DataFrame, occurrences: DataFrame, df: DataFrame, text_col: str, threshold: float, support: int = SUPPORT) -> DataFrame:
    """``(__id, __sum, term, disclosure)``: terms of a text that reveal one of its entities by at least ``threshold``, with the greatest value.

    Co-occurrence is counted over whole texts and classes of terms and entities.
    As a term and an entity meet in no more texts than the entity has, a term of
    more than ``N (of_entity / N) ** threshold`` texts can't reach the threshold;
    such pairs are left out before they are counted, and no others.
    """
    keys = ["__id", "__sum"]
    documents = float(max(only_row(df.agg(F.count(F.lit(1)).alias("n")))["n"], 1))
    holders = found.select(*keys, F.explode(F.array_distinct(F.transform("entities", lambda x: x["entity"]))).alias("entity")).distinct()
    entities = _classes(holders, "entity", "of_entity", F.count(F.lit(1)), support)
    held = written(holders.join(entities, "entity").select(*keys, "of_entity", F.col("class").alias("entity_class")).distinct(), "held")
    most = F.lit(documents) * F.pow(F.col("of_entity") / documents, F.lit(threshold)) * (1 + 1e-9)
    widest = only_row(held.agg(F.max(most).alias("most")))["most"] or 0.0
    counts = document_counts(df, F.col(text_col)).filter(F.col("n") <= widest)
    within = occurrences.select(*keys, "term").distinct().join(counts, "term")
    classes = _classes(within, "term", "of_term", F.first("n"), support)
    terms = written(within.select(*keys, "term").join(classes, "term").select(*keys, "term", "of_term", F.col("class").alias("term_class")), "terms")
    met = held.join(terms.select(*keys, "of_term", "term_class").distinct(), keys).filter(F.col("of_term") <= most)
    information = F.log2(F.lit(documents) / F.col("of_entity"))
    mutual = F.log2(F.lit(documents) * F.col("both") / (F.col("of_entity") * F.col("of_term")))
    pairs = met.groupBy("entity_class", "term_class", "of_entity", "of_term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= support)
    risky = pairs.withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(F.lit(0.0))).filter(F.col("disclosure") >= threshold)
    marked = met.join(written(risky.select("entity_class", "term_class", "disclosure"), "risky"), ["entity_class", "term_class"])
    marked = marked.groupBy(*keys, "term_class").agg(F.max("disclosure").alias("disclosure"))
    return terms.join(marked, [*keys, "term_class"]).select(*keys, "term", "disclosure")


def document_counts(df: DataFrame, text: Column) -> DataFrame:
    """``(term, n)``: in how many rows each term stands outside addresses, over all rows."""
    terms = F.array_distinct(F.transform(F.regexp_extract_all(masked(text), F.lit(TERM), F.lit(0)), F.lower))
    return df.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def sanitize(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalize: float = GENERALIZE, remove: float = REMOVE, support: int = SUPPORT
) -> DataFrame:
    """``(__id, __sum, doc_id, entities, terms)`` of every row; apply with ``sanitized_text`` or read the spans.

    ``entities`` are the personal data, ``terms`` all occurrences, in the texts
    that hold an entity, of the terms that reveal it, wherever they stand, as
    ``struct(start, kind, end, action)`` with action ``generalize`` or
    ``remove``. A null text is empty and has neither; rows that repeat id and
    text have the same spans; a null id is an id like any other. Ties of
    disclosure with a threshold count as exceeding. An empty table gives no
    rows. Other columns are left out.
    """
    found = written(with_terms(find_entities(df, id_col, text_col)), "entities")
    occurrences = found.select("__id", "__sum", F.explode("words").alias("t")).select("__id", "__sum", "t.*")
    risky = revealing_terms(found, occurrences, df, text_col, generalize, support)
    action = F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalize"))
    marked = occurrences.join(risky, ["__id", "__sum", "term"])
    span = F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", action.alias("action"))
    terms = marked.groupBy("__id", "__sum").agg(F.array_sort(F.collect_set(span)).alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,action:string>>")
    return found.join(terms, ["__id", "__sum"], "left").select("__id", "__sum", "doc_id", "entities", F.coalesce("terms", none).alias("terms"))


def span_list(*spans: Column) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    plain = [F.transform(s, lambda x: F.struct(x["start"], x["kind"], x["end"])) for s in spans]
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(F.concat(*plain)), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def sanitized_text(df: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with entities replaced by their kind, revealing terms by ``[TERM]`` or by nothing."""
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    entity = F.transform("entities", lambda x: F.struct(x["start"], x["end"], F.get(label, x["kind"]).alias("replacement")))
    term = F.transform("terms", lambda x: F.struct(x["start"], x["end"], F.when(x["action"] == "remove", F.lit("")).otherwise(F.lit("[TERM]")).alias("replacement")))
    spans = marked.select("__id", "__sum", disjoint(F.array_sort(F.concat(entity, term))).alias("__spans")).dropDuplicates(["__id", "__sum"])
    joined = row_key(df, id_col, text_col).join(spans, ["__id", "__sum"], "left")
    return joined.withColumn(text_col, replaced(F.col(text_col), F.col("__spans"))).drop("__id", "__sum", "__spans")
