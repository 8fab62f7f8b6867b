"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || doc_id::VARCHAR) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s0),
s2 AS (SELECT *, 3 * ss AS most, (3 * ss)::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *,
  (sum(ss) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lft,
  (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS lw FROM s2),
s4 AS (SELECT *, ratio <= lft::DOUBLE / lw AS capped FROM s3),
s5 AS (SELECT *, max(CASE WHEN NOT capped THEN lft END) OVER () AS sh,
                 max(CASE WHEN NOT capped THEN lw END) OVER () AS shw FROM s4),
s6 AS (SELECT source, ss, CASE WHEN capped THEN most::DOUBLE ELSE (w * sh)::DOUBLE / shw END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN ss > 0 THEN floor(floor(target) / ss)::BIGINT ELSE 0 END AS epochs FROM s6),
p AS (SELECT doc_id, size, ss, target, epochs, floor(target)::BIGINT - epochs * ss AS rest,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef
      FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source)
SELECT doc_id, size, ss AS source_size, target,
       (epochs * size + greatest(0, least(size, rest - bef)))::BIGINT AS taken
FROM p
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.simhash import simhash_components
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.decontam import decontaminate
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


SQL["op9_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, occ.n, i, item_id FROM occ JOIN win ON occ.n = win.n AND occ.p = win.p),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hits GROUP BY doc_id),
-- one edit leaves the first or the second half of a phrase as it is; the other half follows it, read away from it
long AS (SELECT item_id, string_split(p, ' ') AS t, n, n // 2 AS h FROM win WHERE n >= 5),
half AS (SELECT DISTINCT item_id, h AS k, array_to_string(t[:h], ' ') AS p, t[h + 1:] AS r, 1 AS way FROM long
         UNION ALL SELECT DISTINCT item_id, n - h, array_to_string(t[h + 1:], ' '), list_reverse(t[:h]), -1 FROM long),
ks AS (SELECT DISTINCT k FROM half),
place AS (SELECT doc_id, w, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
side AS (SELECT doc_id, item_id, r, len(r) AS m,
           CASE WHEN way = 1 THEN w[i + half.k:i + half.k + len(r)]
                ELSE list_reverse(w[greatest(1, i - len(r) - 1):i - 1]) END AS d
         FROM place JOIN half ON place.k = half.k AND place.p = half.p),
nearly AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM side
  WHERE list_sum([CASE WHEN r[j] = d[j] THEN 1 ELSE 0 END FOR j IN generate_series(1, m)]) >= m - 1
     OR list_contains([list_concat(r[:j - 1], r[j + 1:]) = d[:m - 1] FOR j IN generate_series(1, m)], true)
     OR (len(d) = m + 1 AND list_contains([list_concat(d[:j - 1], d[j + 1:]) = r FOR j IN generate_series(1, m)], true))
  GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
LEFT JOIN nearly ON dw.doc_id = nearly.doc_id
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.quality import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.langid import identify
    return identify(table(spark, sf_dir, "documents"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.pii import personal_data
    return personal_data(table(spark, sf_dir, "documents")).withColumn(
        "base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.secret_scan import secrets
    return secrets(table(spark, sf_dir, "documents")).withColumn(
        "base_sha256", F.sha2("base_spans", 256)).drop("base_spans")


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.suffix import remove_repeated_bytes, removed_bytes
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed_bytes(F.col("removed")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op5_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, x, unnest(generate_series(0, length(x) // 2 - 50)) AS i FROM d WHERE length(x) >= 100)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
st AS (SELECT w.doc_id, i FROM w JOIN m ON w.s = m.s WHERE m.first < w.doc_id),
runs AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) < i - 50, true) AS new FROM st),
numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM runs),
sp AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev FROM sp),
agg AS (SELECT gaps.doc_id, sum(b - a) AS rem, count(*) AS n, max(b) AS last,
               string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept
        FROM gaps JOIN d ON gaps.doc_id = d.doc_id GROUP BY gaps.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(rem, 0)::BIGINT AS n_removed,
       coalesce(n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id
"""


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.substring import remove_repeated_words
    return remove_repeated_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
st AS (SELECT s.doc_id, i FROM s JOIN m ON s.s = m.s WHERE m.first < s.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM st),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS k
         FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) u
         LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p WHERE gone.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from riskspark.llm.line_dedup import remove_aligned_lines
    return remove_aligned_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.prefix_trie import shared_prefix_trie
    return shared_prefix_trie(table(spark, sf_dir, "conversations"))


SQL["op11_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT DISTINCT conv_id, encode(conv_id::VARCHAR) AS b FROM own),
-- CRC-32, byte by byte and bit by bit
crc AS (
  WITH RECURSIVE r AS (
    SELECT conv_id, b, 0 AS k, 4294967295::BIGINT AS c FROM bits
    UNION ALL
    SELECT conv_id, b, k + 1, CASE WHEN k % 9 = 0
             THEN xor(c, ('0x' || substr(hex(b), 2 * (k // 9) + 1, 2))::BIGINT)
             WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM r WHERE k < 9 * octet_length(b))
  SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM r WHERE k = 9 * octet_length(b)),
base AS (SELECT conv_id, h, conv_id - conv_id % 5 AS g FROM crc),
given AS (SELECT b.conv_id, o.i, o.role, o.text FROM base b JOIN own o ON o.conv_id = b.g AND o.i <= b.h),
n_given AS (SELECT b.conv_id, b.h, count(g.i) AS n FROM base b LEFT JOIN given g ON g.conv_id = b.conv_id GROUP BY ALL),
t AS (SELECT * FROM given
      UNION ALL SELECT o.conv_id, o.i - n.h + n.n, o.role, o.text
      FROM own o JOIN n_given n ON n.conv_id = o.conv_id AND o.i > n.h),
paths AS (
  SELECT conv_id, i AS depth, octet_length(encode(text)) AS size,
         list(md5(octet_length(encode(role)) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM t
  UNION ALL SELECT conv_id, 0, 0, [] FROM base),
len AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(CASE WHEN depth = n THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM paths JOIN len USING (conv_id) GROUP BY p, depth),
kids AS (SELECT p[:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
whole AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
below AS (
  SELECT p[:d] AS p, sum((n_convs - 1) * size) AS saved, sum((n_children = 0)::INT) AS leaves
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM whole) GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN below ON below.p = w.p LEFT JOIN whole up ON w.depth > 0 AND up.p = w.p[:w.depth - 1]
"""


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.token_alignment import align_tokenizers
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskspark.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"))
