"""Secret scan with a random forest against false positives.

Candidates are runs of token characters that hold a digit, published formats,
signed tokens as a whole, what is assigned to a name like a password's, and
passwords in addresses. Each gets features
of itself (length, kinds of characters, how usual its character transitions
are in the corpus, how much of it dictionary words cover), of the path it was
found at, and of the words beside it. A random forest learns from labelled
findings which candidates are secrets. Everything runs as DataFrame functions
and Spark's own classifier.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.spans import disjoint, parts_of, replaced, row_key, term_counts, with_matches
from motefield.session import written

_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?"
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*+://[^\s/@:]*+:"
#: Patterns whose matches end with a candidate, those that win where matches overlap first, and what stands before it in them.
#: A value that is assigned has six characters at least; without a digit it must follow an equals sign directly.
WHOLE = {
    "signed": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", None),
    "login": (rf"(?<![A-Za-z0-9+.-]){_SCHEME}[^\s/@]++(?=@)", f"^{_SCHEME}"),
    "assigned": (
        rf"{_NAME}(?:=[\"']?[^\s\"'<>,;&]{{6,}}+|\s{{0,3}}[=:]\s{{0,3}}[\"']?(?=[^\s\"'<>,;0-9]*+[0-9])[^\s\"'<>,;]{{6,}}+)",
        rf"^{_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?",
    ),
    "published": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", None),
}
_NEEDS = {"signed": "eyJ", "login": "://"}
#: Token characters with a digit somewhere, 12 at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+=*+"
WORD = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?!\p{N})"
#: Code points looked at on each side of a candidate.
SIDE = 40
#: A word of the dictionary occurs in so many rows at least.
DICTIONARY_ROWS = 3
#: Labelled findings the forest is fitted on at most, and its shape.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 6, 7
# Published token formats, and words that go with secrets or with harmless tokens.
FORMATS = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)$"
ASSIGNED = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?$"
#: What stands before a password in an address.
CREDENTIAL = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/@:]*:$"
SECRET_WORD = r"(?i)password|passwd|secret|token|key|auth|credential|bearer"
HARMLESS_WORD = r"(?i)example|sample|dummy|placeholder|commit|checksum|sha|uuid|isbn|phone|card|tel"
TEST_PATH = r"(?i)test|example|sample|mock|fixture|doc"

FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "mark_share", "hex_only", "digits_only", "changes", "transition", "coverage",
    "path_length", "path_depth", "test_path", "secret_word", "harmless_word", "assigned", "quoted", "in_address", "known_format",
]


def _tails(matches: str, prefix: str) -> Column:
    """The matches without what stands before the candidate in them."""
    values = F.transform(matches, lambda m: F.struct(m["end"], F.regexp_replace(m["value"], prefix, "").alias("value")))
    return F.transform(values, lambda m: F.struct((m["end"] - F.length(m["value"])).alias("start"), m["end"].alias("end"), m["value"].alias("value")))


def _free(matches: str, taken: str) -> Column:
    """The matches that overlap none of those taken."""
    return F.filter(matches, lambda m: ~F.exists(taken, lambda x: (x["start"] < m["end"]) & (x["end"] > m["start"])))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(__id, __sum, doc_id, path, start, end, value, before, after)``: every candidate with its surroundings."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in df.columns else F.lit("")
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    patterns = {name: pattern for name, (pattern, _) in WHOLE.items()} | {"token": CANDIDATE}
    found = with_matches(row_key(rows, "doc_id", "text"), F.col("text"), patterns, _NEEDS)
    for name, (_, prefix) in WHOLE.items():
        if prefix:
            found = found.withColumn(name, _tails(name, prefix))
    taken = "signed"
    for name in [*list(WHOLE)[1:], "token"]:
        found = found.withColumn(f"__{name}", F.concat(taken, _free(name, taken)))
        taken = f"__{name}"
    found = found.select("__id", "__sum", "doc_id", "path", "text", F.array_sort(taken).alias("found")).filter(F.size("found") > 0)
    sides = {
        "before": F.transform("found", lambda m: F.struct(F.greatest(F.lit(0), m["start"] - SIDE).alias("begin"), m["start"].alias("end"))),
        "after": F.transform("found", lambda m: F.struct(m["end"].alias("begin"), (m["end"] + SIDE).alias("end"))),
    }
    around = found.select("__id", "__sum", "doc_id", "path", "found", *[parts_of(F.col("text"), bounds).alias(name) for name, bounds in sides.items()])
    each = around.select("__id", "__sum", "doc_id", "path", F.explode(F.arrays_zip("found", "before", "after")).alias("x"))
    return each.select("__id", "__sum", "doc_id", "path", "x.found.*", "x.before", "x.after")


def _char_class(value: Column) -> Column:
    """Letters as they are, other characters as classes, so that there are at most 29 symbols."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "-"), " ", "-")


def transitions(words: DataFrame) -> DataFrame:
    """``(pair, logp)``: natural log of the share of each character pair among those with its first character; under 900 rows."""
    symbols = _char_class(F.col("term"))
    pairs = words.select("n", symbols.alias("s")).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair"))
    counted = pairs.filter(F.length("pair") == 2).groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = counted.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    return counted.withColumn("first", F.substring("pair", 1, 1)).join(firsts, "first").select("pair", F.log((F.col("n") + 1) / (F.col("total") + 29)).alias("logp"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with one column for each of ``FEATURES``; ``words`` are the corpus' ``(term, n)``."""
    values = found.select("value").distinct()
    rare = F.lit(-7.0)
    symbols = values.select("value", _char_class(F.col("value")).alias("s"))
    steps = symbols.select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair"))
    usual = steps.join(transitions(words), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("logp", rare)).alias("transition"))
    parts = values.select("value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("term"))
    covered = parts.join(words.filter(F.col("n") >= DICTIONARY_ROWS), "term", "left_semi").groupBy("value").agg(F.sum(F.length("term")).alias("covered"))
    v, n = F.col("value"), F.length("value").cast("double")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(v, pattern, "")) / n

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    columns = {
        "length": n, "digit_share": share("[^0-9]"), "upper_share": share("[^A-Z]"), "lower_share": share("[^a-z]"), "mark_share": share("[A-Za-z0-9]"),
        "hex_only": flag(v.rlike("^[0-9a-fA-F]+$")), "digits_only": flag(v.rlike("^[0-9-]+$")),
        "changes": F.regexp_count(v, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")).cast("double"),
        "transition": F.coalesce("transition", rare), "coverage": F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / n),
        "path_length": F.length("path").cast("double"), "path_depth": F.regexp_count(F.col("path"), F.lit("/")).cast("double"), "test_path": flag(F.col("path").rlike(TEST_PATH)),
        "secret_word": flag(F.col("before").rlike(SECRET_WORD)), "harmless_word": flag(F.concat("before", "after").rlike(HARMLESS_WORD)),
        "assigned": flag(F.col("before").rlike(ASSIGNED) | (F.col("before").rlike(CREDENTIAL) & F.col("after").rlike("^@"))), "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "in_address": flag(F.col("before").rlike("[@.:/]$") | F.col("after").rlike("^[@.][A-Za-z0-9]")), "known_format": flag(v.rlike(FORMATS)),
    }
    joined = found.join(usual, "value", "left").join(covered, "value", "left")
    return joined.withColumns({c: columns[c] for c in FEATURES}).drop("covered")


def rule_labels(features: DataFrame) -> Column:
    """Labels that need no reviewer: 1 for published formats and assignments, 0 for numbers and addresses, else null."""
    return (
        F.when((F.col("known_format") == 1) | ((F.col("assigned") == 1) & (F.col("harmless_word") == 0)), F.lit(1.0))
        .when((F.col("in_address") == 1) | (F.col("digits_only") == 1) | (F.col("coverage") > 0.6), F.lit(0.0))
    )


def fit(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """A forest on at most ``sample`` labelled findings, those of least hash; None unless both labels occur."""
    order = F.md5(F.concat_ws("|", "value", "before", F.lit(SEED)))
    rows = written(labelled.filter(F.col("label").isNotNull()).orderBy(order, "value", "before", "after").limit(sample).select("label", *FEATURES), "labelled")
    if rows.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(vectors)


def scan(
    df: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", sample: int = SAMPLE
) -> DataFrame:
    """``(__id, __sum, doc_id, start, end, value, probability, secret)`` for every candidate of every whole text.

    ``labelled`` holds reviewed findings ``(value, label)``; without it the
    findings that rules can label are the examples. A finding is a secret if
    the forest gives it ``threshold`` or more. Where only one label occurs there
    is no forest: known labels decide, and what no rule labels is no secret. A null text has no candidates, a null path
    is empty, a null id is an id like any other, rows that repeat id and text
    have the same findings once for each row. No candidate, no rows.
    """
    found = written(candidates(df, id_col, text_col, path_col), "candidates")
    words = written(term_counts(df, F.col(text_col), WORD), "words")
    rows = written(with_features(found, words), "features")
    rules = rule_labels(rows)
    if labelled is None:
        examples = rows.withColumn("label", rules)
    else:
        known = labelled.groupBy("value").agg(F.max("label").cast("double").alias("label"))
        examples = rows.join(known, "value")
    model = fit(examples, sample)
    if model is None:
        judged = rows.withColumn("probability", F.coalesce(rules, F.lit(0.0)))
    else:
        judged = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)).withColumn("probability", vector_to_array("probability")[1])
    return judged.select("__id", "__sum", "doc_id", "start", "end", "value", "probability", (F.col("probability") >= threshold).alias("secret"))


def redacted(df: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every finding that is a secret replaced in the text."""
    span = F.struct("start", "end", F.lit(label).alias("replacement"))
    spans = findings.filter("secret").groupBy("__id", "__sum").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    joined = row_key(df, id_col, text_col).join(spans.withColumn("__spans", disjoint(F.col("spans"))).drop("spans"), ["__id", "__sum"], "left")
    return joined.withColumn(text_col, replaced(F.col(text_col), F.col("__spans"))).drop("__id", "__sum", "__spans")
