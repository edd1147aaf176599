"""One query per operator over the given tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creativeaudit.llm import exact, katz, licences, lines, minhash, mixing, negatives, passages, pieces, quality, spelling, topk, warc
from creativeaudit.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people called good and not toxic: the text that quality is measured against."""
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classified(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.select("doc_id", "lang", "units", "perplexity", "threshold", "kept")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pages have no time of capture: one a second.
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id"))
    out = warc.capture_histories(table(spark, sf_dir, "pages"), at)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return katz.scores(table(spark, sf_dir, "documents"), held_out)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_sentencepiece, op3_mix_sources, op4_line_dedup, op5_exact_dedup, op6_substring_dedup, op7_top_k, op8_warc, op9_licence_scan, op10_near_duplicates,
    op11_spelling_variants, op12_hard_negatives, op13_language_model)}

#: Hashes, running sums and one boundary row per source; what the histograms find without sorting.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3.0::DOUBLE * source_size AS bound, sum(source_size) OVER () AS total,
         coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
g AS (SELECT *, (total - filled) / open_weight AS lvl, (total - filled) / open_weight * weight > bound AS is_full FROM f),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN bound ELSE
         least(bound, weight * (SELECT arg_min(lvl, filled) FROM g WHERE NOT is_full)) END AS target
  FROM g),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
b AS (
  SELECT d.doc_id, d.size, d.h, w.source_size, w.target, w.whole, greatest(0, w.target - w.whole * w.source_size) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - tied <= rest AND 2 * (rest - (upto - tied)) > tied) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM b
"""

#: Runs of two lines, blank ones skipped over; a line goes if a run over it also starts earlier.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, list_zip(str_split(text, chr(10)), range(len(str_split(text, chr(10))))) AS xs FROM documents),
l AS (SELECT doc_id, unnest(list_filter(xs, lambda x: regexp_matches(x[1], '[^\x20\x09-\x0D]'))) AS x FROM d),
p AS (SELECT doc_id, x[1] AS line, x[2] AS nth, row_number() OVER w AS pos, lead(x[1]) OVER w AS next_line
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY x[2])),
f AS (SELECT *, next_line IS NOT NULL AND row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, pos) > 1 AS late FROM p),
g AS (SELECT *, late OR coalesce(lag(late) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM f),
r AS (SELECT doc_id, list(nth) AS ats FROM g WHERE gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(r.ats), 0)::BIGINT AS n_lines_removed,
       sha256(CASE WHEN r.ats IS NULL THEN d.text ELSE
              coalesce(list_aggregate(list_transform(list_filter(d.xs, lambda x: NOT list_contains(r.ats, x[2])), lambda x: x[1]), 'string_agg', chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

TOP_K_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: DuckDB has no base 32: the digest is SHA-1 in hexadecimal, forty bits at a time as eight base-32 letters.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hexed FROM p),
g AS (SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hexed, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest
      FROM h),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hexed) AS best, count(*) OVER (PARTITION BY hexed) AS n FROM g)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM w
"""

#: crc32 from its table of 256 remainders, byte by byte; words one edit apart share what one deletion leaves of them.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS rest),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY 1, 2),
x AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM r),
h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(hexed) // 2), lambda i: ('0x' || substr(hexed, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1]))) AS h
  FROM x, t),
w AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT DISTINCT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
b AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(near, (-n, encode(near))) AS best FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.best_n >= 2 * w.n THEN b.best END AS form,
         CASE WHEN b.best_n >= 2 * w.n THEN b.best_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, form, word AS root FROM f UNION ALL SELECT c.word, f.form, f.word FROM c JOIN f ON c.form = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON f.word = c.word AND c.form IS NULL
"""

NEGATIVES_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM s WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND s.score * 100 BETWEEN 80 * p.positive_score AND 100 * p.positive_score
QUALIFY rank <= 5
"""

ORACLE: dict[str, str] = {"op7_top_k": TOP_K_SQL, "op8_warc": WARC_SQL, "op3_mix_sources": MIX_SQL, "op4_line_dedup": LINES_SQL, "op5_exact_dedup": EXACT_SQL,
                          "op11_spelling_variants": SPELLING_SQL, "op12_hard_negatives": NEGATIVES_SQL}
