"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Every query runs its operator over the whole table and derives the digest
columns from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, divergence, html_crf, interaction, langid, media, quality, secrets, simhash, suffixdedup, toxicity
from aerolith.llm.common import read
from aerolith.llm.decontaminate import decontaminate, items_digest
from aerolith.llm.linededup import dedup_lines

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items_digest(F.col("item_ids")).alias("items_sha256"), "contaminated", spans.alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.col(out.columns[-1])
    return out.select("doc_id", lines["n_lines"].alias("n_lines"), lines["n_dropped"].alias("n_dropped"), F.sha2(lines["kept"].cast("binary"), 256).alias("kept_sha256"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secrets.spans_text(F.col("spans"), secrets.KINDS[:3])
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, how = read(spark, sf_dir, "documents"), (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    tokens = bpe.digest_column(F.col("text"), *how, bpe.shared_chunks(docs, *how))
    return docs.select("doc_id", tokens.alias("t")).select("doc_id", "t.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixdedup.dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = F.col(out.columns[-1])
    return out.select("doc_id", *[found[c].alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.sha2(found["kept"], 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", media.digest_column(F.col("text")).alias("m")).select("doc_id", "m.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.language_column(docs, model).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.interaction_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_html_text, op4_line_dedup, op5_bpe, op6_quality, op7_substrings, op8_simhash, op9_media, op10_language, op11_divergence, op12_toxicity, op13_filter_interaction)}

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS pat FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM p),
h AS (SELECT c.r, c.k, c.n, p.item FROM (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS pat FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS k FROM d, s WHERE len(d.w) >= s.n)) c JOIN p USING (n, pat)),
u AS (SELECT DISTINCT r, unnest(range(k, k + n)) AS i FROM h), x AS (SELECT r, count(*) AS n_hit FROM u GROUP BY r),
t AS (SELECT r, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS j FROM (SELECT row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS toks FROM documents)),
o AS (SELECT r, tok, sum(length(tok)) OVER (PARTITION BY r ORDER BY j) AS stop FROM t WHERE r IN (SELECT r FROM u)), m AS (SELECT r, stop - length(tok) AS start, stop, row_number() OVER (PARTITION BY r ORDER BY stop) AS i FROM o WHERE regexp_matches(tok, '^[^\x00-\x2F\x3A-\x60\x7B-\x7F]')),
e AS (SELECT r, min(start) AS a, max(stop) AS z FROM (SELECT u.r, start, stop, u.i - row_number() OVER (PARTITION BY u.r ORDER BY u.i) AS run FROM u JOIN m ON m.r = u.r AND m.i = u.i) GROUP BY r, run), f AS (SELECT r, string_agg(cast(a AS BIGINT) || ':' || cast(z AS BIGINT), ',' ORDER BY a) AS spans FROM e GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(spans, '') AS spans
FROM d LEFT JOIN x USING (r) LEFT JOIN y USING (r) LEFT JOIN f USING (r)
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r, doc_id
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
z AS (SELECT r, base, substr(h, 2 * base + 1, 2 * (256 + 99)) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 99, 256)) AS base FROM d WHERE length(h) >= 200)),
p AS (SELECT r, base + j AS i, hash(substr(h, 2 * j + 1, 200)) AS s, r * 4294967296 + base + j AS pl FROM (SELECT r, base, h, unnest(range(0, length(h) // 2 - 99)) AS j FROM z)),
q AS (SELECT s, min(pl) AS first FROM p GROUP BY s HAVING count(*) > 1),
a AS (SELECT p.r, p.i, CASE WHEN p.i - lag(p.i) OVER (PARTITION BY p.r ORDER BY p.i) <= 100 THEN 0 ELSE 1 END AS new FROM p JOIN q USING (s) WHERE p.pl <> q.first),
n AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM a),
v AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY r, k),
g AS (SELECT v.r, v.a, v.b, d.h, lag(v.b, 1, 0) OVER w AS was, row_number() OVER w = count(*) OVER (PARTITION BY v.r) AS last FROM v JOIN d USING (r) WINDOW w AS (PARTITION BY v.r ORDER BY v.a)),
k AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)) || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM g GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op4_line_dedup": OP4_SQL, "op7_substrings": OP7_SQL, "op11_divergence": divergence.SQL, "op13_filter_interaction": interaction.SQL}
