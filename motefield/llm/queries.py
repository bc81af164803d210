"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


@query("""
WITH v AS (
    SELECT vec_id, max(e) AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) GROUP BY vec_id),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn <= 10
""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS largest FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (j // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM g
""")
def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.warc import archive_round_trip

    read = archive_round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.pieces import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.packing import pack, token_count

    return pack(read_table(spark, sf_dir, "documents"), token_count(F.col("text")))


@query("""
WITH l AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents WHERE text IS NOT NULL),
t AS (
    SELECT doc_id, text, n, line, list_transform(string_split(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), ' '),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tok FROM l),
k AS (
    SELECT doc_id, text, n, line, CASE WHEN len(tok) < 2 OR (len(tok) < 4 AND list_contains(tok, '<*>')) THEN [] WHEN len(tok) < 10 THEN ['-1|' || array_to_string(tok, ' ')]
        ELSE list_transform(range(0, 5), lambda i: i || '|' || len(tok) || '|' || array_to_string(list_slice(tok, 1, 3), ' ') || '|'
            || array_to_string(list_slice(tok, 4, 3 + CAST(floor((len(tok) - 3) * i / 5) AS INTEGER)), ' ') || '|'
            || array_to_string(list_slice(tok, 4 + CAST(floor((len(tok) - 3) * (i + 1) / 5) AS INTEGER), len(tok)), ' ')) END AS keys FROM t),
c AS (
    SELECT key, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM (SELECT doc_id, unnest(keys) AS key FROM k) GROUP BY key
    HAVING count(DISTINCT doc_id) >= CASE WHEN starts_with(key, '-1|') THEN 3 ELSE 2 END),
gone AS (
    SELECT DISTINCT doc_id, n FROM (SELECT doc_id, n, unnest(keys) AS key FROM k) JOIN c USING (key) WHERE doc_id <> first)
SELECT k.doc_id, count(*) AS n_lines, count(gone.n) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k.n) FILTER (WHERE gone.n IS NULL), '')) AS text_sha256
FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.n = gone.n GROUP BY k.doc_id
""")
def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.linededup import drop_recurring_lines

    left = drop_recurring_lines(read_table(spark, sf_dir, "documents"), min_docs=3, long_docs=2)
    return left.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped_lines").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


@query()
def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.tokens import encoded_lengths, length_histogram, suffix_sums

    return suffix_sums(length_histogram(encoded_lengths(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))))


@query()
def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.quality import quality

    return quality(read_table(spark, sf_dir, "documents"))


@query()
def op8_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query("""
WITH RECURSIVE p AS (SELECT * FROM (VALUES
        ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'),
        ('card', 2, '[0-9]([\\x20-]?[0-9])+'), ('phone', 3, '\\+[0-9][\\x20().0-9-]+[0-9]')) AS t(kind, ord, pat)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (
    SELECT doc_id, kind, ord, hits, regexp_split_to_array(text, pat) AS gaps
    FROM (SELECT doc_id, text, kind, ord, pat, regexp_extract_all(text, pat) AS hits FROM d, p) WHERE len(hits) > 0),
m AS (
    SELECT doc_id, kind, ord, unnest(hits) AS v, unnest(list_transform(range(1, len(hits) + 1), lambda i:
        list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0))) AS s FROM h),
b AS (
    SELECT doc_id, kind, ord, CAST(s AS BIGINT) AS s, CAST(s AS BIGINT) + length(v) AS e, v, regexp_replace(v, '[^0-9]', '', 'g') AS dg FROM m),
ok AS (
    SELECT doc_id, kind, ord, s, e, CASE kind WHEN 'email' THEN 'email:' || lower(v) WHEN 'ip' THEN 'ip:' || v ELSE kind || ':' || dg END AS entity FROM b WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
    WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15
    ELSE length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, length(dg)), lambda i: (
        CASE WHEN i % 2 = 0 THEN CAST(substr(dg, CAST(length(dg) - i AS INTEGER), 1) AS INTEGER)
        WHEN CAST(substr(dg, CAST(length(dg) - i AS INTEGER), 1) AS INTEGER) > 4 THEN 2 * CAST(substr(dg, CAST(length(dg) - i AS INTEGER), 1) AS INTEGER) - 9
        ELSE 2 * CAST(substr(dg, CAST(length(dg) - i AS INTEGER), 1) AS INTEGER) END))) % 10 = 0 END),
tl AS (
    SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS hits, regexp_split_to_array(text, '[\\p{L}\\p{N}]+') AS gaps FROM d),
tu AS (SELECT doc_id, n, unnest(hits) AS v, unnest(list_transform(gaps[:len(hits)], lambda g: length(g))) AS g, unnest(range(0, len(hits))) AS i FROM tl),
tp AS (
    SELECT doc_id, n, v, CAST(sum(g) OVER w + sum(length(v)) OVER w - length(v) AS BIGINT) AS s FROM tu WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
tm AS (SELECT doc_id, n, lower(v) AS term, s, s + length(v) AS e FROM tp WHERE regexp_full_match(v, '\\p{L}{3,}')),
nr AS (SELECT * FROM tm WHERE NOT EXISTS (SELECT 1 FROM ok o2 WHERE o2.doc_id = tm.doc_id AND o2.s < tm.e AND o2.e > tm.s)),
oh AS (SELECT DISTINCT doc_id, entity FROM ok),
th AS (SELECT DISTINCT doc_id, term FROM nr),
j AS (SELECT entity, term, count(*) AS n_both FROM oh JOIN th USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
oe AS (SELECT entity, count(*) AS n_e FROM oh GROUP BY ALL),
ot AS (SELECT term, count(*) AS n_t FROM th GROUP BY ALL),
al AS (SELECT CAST(count(*) AS DOUBLE) AS n_all FROM d),
rk AS (
    SELECT entity, term FROM j JOIN oe USING (entity) JOIN ot USING (term), al
    WHERE n_all > n_e AND log2(n_all * n_both / (n_e * n_t)) / log2(n_all / n_e) >= 0.7),
st AS (SELECT DISTINCT nr.doc_id, 'term' AS kind, 4 AS ord, s, e FROM nr JOIN rk USING (term) JOIN oh ON oh.doc_id = nr.doc_id AND oh.entity = rk.entity),
sp AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans, count(*) FILTER (WHERE kind = 'term') AS n_terms
    FROM (SELECT doc_id, kind, ord, s, e FROM ok UNION ALL SELECT * FROM st) GROUP BY doc_id)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord), '')) AS base_sha256,
    coalesce(any_value(sp.spans), '') AS spans, coalesce(any_value(sp.n_terms), 0) AS n_terms
FROM d LEFT JOIN ok ON d.doc_id = ok.doc_id LEFT JOIN sp ON d.doc_id = sp.doc_id GROUP BY d.doc_id
""")
def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.pii import KINDS, sanitize, span_list

    marked = sanitize(read_table(spark, sf_dir, "documents"))
    kinds = F.transform("entities", lambda x: x["kind"])
    counts = [(F.size("entities") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    base = F.sha2(span_list(F.col("entities")), 256).alias("base_sha256")
    return marked.select("doc_id", *counts, base, span_list(F.col("entities"), F.col("terms")).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


@query()
def op7_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.secrets import scan

    found = scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "secret")


@query("""
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id, vec_id AS seen FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
""")
def op11_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.rangejoin import similar_vectors

    return similar_vectors(read_table(spark, sf_dir, "embeddings"))


@query()
def op12_segment_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.importance import draw, importance_weights

    return draw(importance_weights(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from motefield.llm.alignment import align_tokens

    return align_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
