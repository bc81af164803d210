"""Spans of pattern matches as columns, without Python: offsets are code points, the end is exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.vectors import let


def with_matches(df: DataFrame, text: Column, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """Add an array column for each pattern: ``struct(start, end, value)`` of its leftmost non-overlapping matches.

    A text is cut at the matches; lengths of the pieces and of the matches give
    the offsets. ``needs`` names a character without which a pattern can't match.
    """
    needs = needs or {}
    steps, spans = {}, {}
    for name, pattern in patterns.items():
        may = text.contains(needs[name]) if name in needs else text.isNotNull()
        steps[f"__hit_{name}"] = F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        hits = F.col(f"__hit_{name}")
        gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1))
        steps[f"__gap_{name}"] = F.slice(gaps, F.lit(1), F.size(hits))
    out = df
    for name, column in steps.items():
        out = out.withColumn(name, column)
    for name in patterns:
        hits, gaps = F.col(f"__hit_{name}"), F.col(f"__gap_{name}")
        widths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), (F.length(g) + F.length(h)).alias("w")))
        found = F.zip_with(_starts(widths), hits, lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value")))
        spans[name] = F.coalesce(F.when(F.size(hits) > 0, found), F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return out.withColumns(spans).drop(*steps)


#: Matches whose widths are added up together; a power of two.
_CELL_BITS = 6


def _starts(widths: Column) -> Column:
    """Offset of every match of ``array<struct<g, w>>``: gap before it, and both; sums of cells first, so no array grows."""
    cell = 1 << _CELL_BITS

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def within(w: Column, cells: Column) -> Column:
        def start(i: Column) -> Column:
            own = F.shiftright(i, _CELL_BITS)
            before = F.transform(F.slice(w, own * cell + 1, i.bitwiseAND(cell - 1)), lambda x: x["w"])
            return F.get(cells, own) + total(before) + F.get(w, i)["g"]

        return F.transform(F.sequence(F.lit(0), F.size(w) - 1), start)

    def over(w: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.shiftright(F.size(w) - 1, _CELL_BITS))
        sums = F.transform(numbers, lambda k: total(F.transform(F.slice(w, k * cell + 1, F.lit(cell)), lambda x: x["w"])))
        return let(sums, lambda s: let(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: total(F.slice(s, F.lit(1), k))), lambda cells: within(w, cells)))

    return let(widths, over)


#: Code points of the pieces a text is cut into before parts are taken out of it.
_PIECE = 4096


def parts_of(text: Column, bounds: Column) -> Column:
    """The parts of a text between ``array<struct<begin, end>>``, in code points and cut at its end; as long as the parts, wherever they lie."""

    def over(pieces: Column) -> Column:
        def part(b: Column) -> Column:
            first = F.floor(b["begin"] / _PIECE).cast("int")
            n = F.greatest(F.floor((b["end"] - 1) / _PIECE).cast("int") - first + 1, F.lit(1))
            return F.substring(F.array_join(F.slice(pieces, first + 1, n), ""), b["begin"] - first * _PIECE + 1, b["end"] - b["begin"])

        return F.transform(bounds, part)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), over)


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span of ``array<struct<start, end, replacement>>`` replaced.

    The spans must be sorted and disjoint. A null or empty array changes nothing.
    """
    n = F.size(spans)
    pieces = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"] + 1),
                        F.when(i == n, F.length(text)).otherwise(F.get(spans, i)["start"]) - F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(spans, F.greatest(i, F.lit(1)))["end"])),
            F.coalesce(F.get(spans, i)["replacement"], F.lit("")),
        ),
    )
    return F.when(n > 0, F.array_join(pieces, "")).otherwise(text)


def disjoint(spans: Column) -> Column:
    """Of spans sorted by start, those that begin at or after the end of the last one taken."""
    empty = F.slice(spans, 1, 0)
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``__id`` and ``__sum``, for ids of any type: rows that agree in both hold the same text, so they have the same result."""
    return df.withColumns({"__id": F.xxhash64(F.to_json(F.struct(F.col(id_col).alias("id")))), "__sum": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def term_counts(texts: DataFrame, text: Column, pattern: str) -> DataFrame:
    """``(term, n)``: in how many rows each lower-case term occurs, over all rows."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))
    return texts.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
