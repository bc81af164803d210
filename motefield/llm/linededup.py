"""Line deduplication by a log-template tree.

A line is parsed to a fixed depth: the number of its tokens, then its first
``DEPTH`` tokens, variable fields (tokens with a digit) as a wildcard. In a
leaf, lines that agree on at least four fifths of the tail belong to one
template: the tail is cut into five blocks, and a line belongs to the five
templates that put a wildcard in place of one block. A template is the hash of
its path, and the leaf is never held in one place: counting the documents of
each template is a plain aggregation, added up in each task before rows move.
A long line recurs from its second document on; a short one, which documents
may share by chance, needs more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from motefield.session import written

DEPTH = 3
BLOCKS = 5
#: Lines with fewer tokens belong to no template.
LEAST_TOKENS = 2
#: Lines with fewer tokens belong to one only if they have no variable field.
MASKED_TOKENS = 4
#: Lines with fewer tokens have no wildcard but variable fields; the others are long.
WILD_TOKENS = 10
_SPACE = r"[\x20\x09-\x0D]+"


def tokens_of(lines: Column) -> Column:
    """Tokens of every line, those with a digit as ``<*>``. Each step is its own pass, so nothing is worked out twice."""
    plain = F.transform(lines, lambda x: F.when(x.rlike(r"[\x09-\x0D]|  |^ | $"), F.trim(F.regexp_replace(x, _SPACE, " "))).otherwise(x))
    masked = F.transform(plain, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^0-9 ]*+[0-9][^ ]*+", "<*>")).otherwise(x))
    return F.transform(masked, lambda x: F.split(x, " "))


def is_long(line: Column) -> Column:
    """Whether a line has tokens enough for wildcards."""
    return F.size(F.split(F.trim(F.regexp_replace(line, _SPACE, " ")), " ")) >= WILD_TOKENS


def _joined(hashes: Column, start: Column, length: Column) -> Column:
    return F.aggregate(F.slice(hashes, start, length), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def _parts(hashes: Column) -> Column:
    """Size of a line, hash of its head, and hashes of the five blocks of its tail; short lines have one block."""
    n = F.size(hashes)
    tail = F.greatest(n - DEPTH, F.lit(0))
    ends = [F.floor(tail * i / BLOCKS).cast("int") for i in range(BLOCKS + 1)]
    blocks = [_joined(hashes, ends[i] + (DEPTH + 1), ends[i + 1] - ends[i]) for i in range(BLOCKS)]
    return F.array(n.cast("bigint"), _joined(hashes, F.lit(1), F.lit(DEPTH)), *blocks)


def _templates(part: Column) -> Column:
    n, head, blocks = part[0], part[1], [part[2 + i] for i in range(BLOCKS)]

    def wild(i: int) -> Column:
        rest = reduce(lambda a, b: a.bitwiseXOR(b), [b for j, b in enumerate(blocks) if j != i])
        return F.xxhash64(F.lit(i), n, head, rest)

    none = F.array().cast("array<bigint>")
    long = F.array(*[wild(i).bitwiseOR(F.lit(1)) for i in range(BLOCKS)])
    return F.when(n < LEAST_TOKENS, none).when(n < WILD_TOKENS, F.array(wild(-1).bitwiseAND(F.lit(-2)))).otherwise(long)


def line_templates(lines: Column) -> Column:
    """For each line the hashes of its templates, odd ones for long lines. A token is hashed once, with its place; blocks are joined by exclusive or."""
    parsed = F.transform(tokens_of(lines), lambda t: F.when((F.size(t) < MASKED_TOKENS) & F.array_contains(t, "<*>"), F.slice(t, 1, 0)).otherwise(t))
    hashed = F.transform(parsed, lambda t: F.transform(t, lambda x, j: F.xxhash64(j, x)))
    return F.transform(F.transform(hashed, _parts), _templates)


def _row_key(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """Name and text hash of a row. Names sort like the ids, which may have any type; each text without an id has one of its own, before all others."""
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    if isinstance(df.schema[id_col].dataType, IntegralType):
        none = F.shiftrightunsigned(text, 2) + F.lit(-(2**63))
        return {"__id": F.coalesce(F.col(id_col).cast("long"), none), "__sum": text}
    return {"__id": F.coalesce(F.concat(F.lit("1"), F.col(id_col).cast("string")), F.concat(F.lit("0"), F.hex(text))), "__sum": text}


def drop_recurring_lines(df: DataFrame, min_docs: int = 3, long_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with recurring lines taken out of ``text``, plus ``n_lines`` and ``dropped_lines``.

    Lines are what stands between newlines. A line recurs if one of its
    templates occurs in at least ``min_docs`` rows, or ``long_docs`` if it has
    ten tokens or more; it stays in the row of smallest id among those and goes
    from all others. ``dropped_lines`` are the 0-based numbers of the lines
    taken out. Lines of fewer than two tokens always stay, and so do lines of
    two or three of which one has a digit. A null text stays null and has no lines, an empty text has one
    empty line. Rows of equal id are one document, and treated alike if they
    repeat the text too; ids may have any type, and each text without an id is
    a document of its own, before all others. Input columns named like the two
    new ones are replaced.
    """
    n_lines = F.size(F.split(F.col(text_col), "\n"))
    row = _row_key(df, id_col, text_col)
    texts = df.filter(F.col(text_col).isNotNull()).select(*[c.alias(n) for n, c in row.items()], F.split(F.col(text_col), "\n").alias("lines"))
    found = written(texts.select("__id", "__sum", line_templates(F.col("lines")).alias("templates")), "templates")
    counted = (
        found.select("__id", F.explode(F.array_distinct(F.flatten("templates"))).alias("template"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first"))
        .filter(F.col("n") >= F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, long_docs).otherwise(min_docs)).select("template", "first")
    )
    lines = found.select("__id", "__sum", F.posexplode("templates").alias("line", "t")).select("__id", "__sum", "line", F.explode("t").alias("template"))
    gone = (
        lines.join(counted, "template").filter(F.col("__id") != F.col("first"))
        .groupBy("__id", "__sum").agg(F.array_sort(F.collect_set("line")).alias("__gone"))
    )
    out = df.drop("n_lines", "dropped_lines").withColumns(row).join(gone, ["__id", "__sum"], "left")
    gone_or_none = F.coalesce("__gone", F.array().cast("array<int>"))
    split = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n"))
    lengths = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines)
    return out.withColumns({"n_lines": lengths, "dropped_lines": gone_or_none, text_col: text}).drop("__id", "__sum", "__gone")
