"""The dealt operators as queries over the given tables, each with its check in SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch
from . import (
    bpe_stream,
    decontaminate,
    heap_clusters,
    html_region,
    ngram_join,
    ordinal_quality,
    risk_rules,
    secret_entropy,
    source_mixture,
    spelling_blocks,
    token_archive,
    token_counts,
    warc_zstd,
)
from .common import prepared, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(prepared(spark), folder)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
    THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle)
    WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
    WHERE 100 * common >= 80 * (a.size + b.size - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.x = e.x)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id FROM documents d
LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(c) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""


@query
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of each document under links of similarity 0.8 or more."""
    return ngram_join.jaccard_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_html_region(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return html_region.main_texts(pages, html_region.learn(pages))


@query
def op3_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade and tail probability of every document."""
    docs = table(spark, folder, "documents")
    model = ordinal_quality.train(docs, table(spark, folder, "labels"))
    return ordinal_quality.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the piece vocabulary."""
    counted = token_counts.token_counts(table(spark, folder, "documents"), vocabulary_path(PIECE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


# All offsets at which a document and an item share words: with the k-th match at place a, 3k - 2a is the score up to there.
ORACLES["op5_decontaminate"] = r"""
WITH w AS (SELECT *, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM (SELECT doc_id AS id, text, true AS doc FROM documents
    UNION SELECT item_id, text, false FROM benchmark)),
u AS (SELECT id, doc, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
m AS (SELECT d.id AS doc_id, i.id AS item_id, i.n, d.place - i.place AS shift, i.place AS at_item FROM u d JOIN u i
    ON d.word = i.word AND d.doc AND NOT i.doc),
g AS (SELECT *, CASE WHEN n < 5 THEN n ELSE least(10, 0.7 * n) END AS needed, count(*) OVER diagonal AS matches,
    3 * row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY at_item) - 2 * at_item AS p FROM m
    WINDOW diagonal AS (PARTITION BY doc_id, item_id, shift)),
s AS (SELECT doc_id, item_id, n, needed, p + 1 - min(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY at_item
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score FROM g WHERE matches >= needed)
SELECT doc_id, item_id, max(score)::INT AS score, max(n)::INT AS words, true AS contaminated FROM s WHERE score >= needed GROUP BY doc_id, item_id
"""


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    found = decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "words", F.lit(True).alias("contaminated"))


END_ID = 2


@query
def op6_token_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, written to seekable files and read back."""
    place = scratch(spark, "token-archive")
    files = token_archive.write(table(spark, folder, "documents"), place, vocabulary_path(BYTE_BPE), END_ID)
    return token_archive.read(files, place, with_ids=False)


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of a compressed archive, read back."""
    place = scratch(spark, "warc")
    files = warc_zstd.write(table(spark, folder, "pages"), place)
    return warc_zstd.read(files, place).drop("payload", "url")


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: fixed patterns and window entropy."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secret_entropy.scan(docs)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(secret_entropy.count_kind(F.col("base_spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secret_entropy.joined(F.col("base_spans")), 256).alias("base_sha256"),
        secret_entropy.joined(F.col("all_spans")).alias("spans"),
    )


@query
def op9_bpe_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and the text that they decode to."""
    return bpe_stream.round_trip_digests(table(spark, folder, "documents"), vocabulary_path(BYTE_BPE))


@query
def op10_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules with cutoffs that are shown to spare clean documents."""
    found = risk_rules.apply_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons"
    )


# The hash of a run is worked out byte by byte, with the usual table of 256 remainders made by its rule.
ORACLES["op11_spelling_blocks"] = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS remainders),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c:
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c // 256, remainders[xor(c % 256, x) + 1]),
    4294967295::BIGINT)) AS hash FROM b, t),
s AS (SELECT CASE WHEN hash % 199 = 0 THEN run[:hash % length(run)] || run[hash % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM w),
x AS (SELECT word, n, place, word[:place - 1] || word[place + 1:] AS short FROM v),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.short = b.short AND a.place = b.place AND a.word <> b.word
    UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.short = w.word
    UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.short = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, min(near.near) AS form, min(near.near_n) AS form_n FROM w
    LEFT JOIN best USING (word) LEFT JOIN near ON near.word = w.word AND near.near_n = most AND most >= 5 * w.n GROUP BY ALL),
c AS (SELECT word AS start, form AS last FROM f WHERE form IS NOT NULL
    UNION SELECT c.start, f.form FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL),
e AS (SELECT c.start, c.last FROM c JOIN f ON f.word = c.last WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.last, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON e.start = f.word
"""


@query
def op11_spelling_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, with the more frequent words that they are misspellings of."""
    return spelling_blocks.spelling_groups(table(spark, folder, "documents"))


def _clusters_sql(clusters: int = 40, rounds: int = 5) -> str:
    """Every round spelled out: distances to all centroids, the nearest one, floors of the means."""

    def nearest(turn: int) -> str:
        return (
            f"a{turn} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM (SELECT vec_id, v, k,"
            f" list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d FROM v, c{turn}) GROUP BY ALL)"
        )

    def means(turn: int) -> str:
        return (
            f"m{turn} AS (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{turn}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),"
            f"l{turn} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{turn} GROUP BY k),"
            f"c{turn + 1} AS MATERIALIZED (SELECT k, coalesce(l{turn}.c, c{turn}.c) AS c FROM c{turn} LEFT JOIN l{turn} USING (k))"
        )

    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM"
        f" (SELECT v, sha256('2:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {clusters}))",
    ]
    for turn in range(rounds):
        parts += [nearest(turn), means(turn)]
    parts.append(nearest(rounds))
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia,"
        f" sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"
    )


ORACLES["op12_heap_clusters"] = _clusters_sql()


@query
def op12_heap_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster of every vector, its distance, and the sums of distances."""
    return heap_clusters.with_inertia(heap_clusters.cluster(table(spark, folder, "embeddings")))


ORACLES["op13_source_mixture"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, [3, 1, 2][(place - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS whole FROM s),
-- Water filling: in ascending order of limit / weight, a source is full while its limit is below its share of the rest.
r AS (SELECT *, 1.5 * whole - coalesce(sum(2 * source_size) OVER before, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights FROM w
    WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, rest::DOUBLE * weight / weights::DOUBLE > 2 * source_size AS above FROM r),
l AS (SELECT coalesce(sum(2 * source_size) FILTER (above), 0) AS taken, greatest(sum(weight) FILTER (NOT above), 1) AS weights FROM f),
t AS (SELECT source, source_size, CASE WHEN above THEN (2 * source_size)::DOUBLE
    ELSE (1.5 * whole - taken)::DOUBLE * weight / l.weights::DOUBLE END AS target FROM f, l),
p AS (SELECT d.doc_id, d.source, size, source_size, target,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST)::HUGEINT AS place,
    ('0x' || sha256('0:' || coalesce(d.source, ''))[:10])::HUGEINT AS first,
    CASE WHEN source_size > 0 THEN floor(target / source_size * 1099511627776)::HUGEINT ELSE 0 END AS expected
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM (SELECT *, ((first + expected * place)
    // 1099511627776 - (first + expected * (place - 1)) // 1099511627776)::INT AS copies FROM p)
"""


@query
def op13_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """How often, and with how many words, each document enters the mix of sources."""
    return source_mixture.taken_words(table(spark, folder, "documents"))
