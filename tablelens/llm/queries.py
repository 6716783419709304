"""The operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, licenses, linededup, media, mixing, neardup, pii, quality, suffixdedup, toxicity, vectorcodes, warc
from .common import materialize, table, work_dir


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_cotrain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.fit(docs))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = work_dir(spark)
    warc.archive(pages, f"{folder}/warc", folder=folder)
    back = warc.read(spark, f"{folder}/warc")
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("record_id").cast(kind).alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).withColumn("tile", F.hex("tile"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = linededup.line_marks(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda p: p.cast("string")), ",").alias("removed"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.transform(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore("output", "form"), 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vectorcodes.fit(table(spark, sf_dir, "embeddings"))
    found = vectorcodes.label_errors(materialize(codes.rows(), work_dir(spark)))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def queries() -> dict:
    ops = (op1_decontaminate, op2_cotrain_quality, op3_pii, op4_license_scan, op5_warc, op6_mix, op7_media, op8_toxicity, op9_neardup, op10_line_dedup, op11_suffix_dedup, op12_fim, op13_vector_codes)
    return {f.__name__: f for f in ops}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all({_LOW.format('coalesce(text, chr(0))')}, '{_WORD}')"

OP1_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g FROM b, unnest(range(greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, l, i, array_to_string(w[i + 1 : i + l], ' ') AS g FROM d, (SELECT DISTINCT l FROM g) ls, unnest(range(greatest(len(w) - l + 1, 0))) t(i)),
h AS (SELECT doc_id, i, x.l, item_id FROM x JOIN g ON x.g = g.g AND x.l = g.l),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(l)) t(j) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""

_VALUES = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
f AS (SELECT phrase, label, len(string_split(phrase, ' ')) AS n FROM (VALUES {_VALUES(licenses.PHRASES.items())}) p(phrase, label)),
b AS (SELECT doc_id, i, label FROM d, f, unnest(range(greatest(len(w) - n + 1, 0))) t(i) WHERE array_to_string(w[i + 1 : i + n], ' ') = phrase),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY doc_id),
p AS (SELECT t_id, label, string_split(words, ' ') AS ws FROM (VALUES {_VALUES((i, label, text) for i, (label, text) in enumerate(licenses.TEMPLATES))}) t(t_id, label, words)),
g AS (SELECT t_id, label, len(ws) - {licenses.K - 1} AS size, p, array_to_string(ws[p + 1 : p + {licenses.K}], ' ') AS g FROM p, unnest(range(len(ws) - {licenses.K - 1})) t(p)),
x AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + {licenses.K}], ' ') AS g FROM d, unnest(range(greatest(len(w) - {licenses.K - 1}, 0))) t(i)),
h AS (SELECT doc_id, t_id, label, size, p, i - p AS diagonal FROM x JOIN g USING (g)),
v AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, t_id ORDER BY diagonal) AS last FROM (SELECT DISTINCT doc_id, t_id, diagonal FROM h)),
m AS (SELECT *, sum(CASE WHEN diagonal - last <= {licenses.NEAR} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t_id ORDER BY diagonal) AS passage FROM v),
s AS (SELECT h.doc_id, any_value(label) AS label, count(DISTINCT p) / CAST(any_value(size) AS DOUBLE) AS share FROM h JOIN m USING (doc_id, t_id, diagonal) GROUP BY h.doc_id, h.t_id, passage),
ss AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS share FROM s WHERE share >= {licenses.COVER} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN ss USING (doc_id)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
f AS (SELECT body, min(page_id) AS low FROM p GROUP BY body),
s AS (SELECT page_id, body, low, sha1(body) AS hex FROM p JOIN f USING (body)),
bits AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i + 1])]), '') AS b FROM s)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(b[i * 5 + 1] AS INT) + 8 * CAST(b[i * 5 + 2] AS INT) + 4 * CAST(b[i * 5 + 3] AS INT) + 2 * CAST(b[i * 5 + 4] AS INT) + CAST(b[i * 5 + 5] AS INT)]), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM bits
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS HUGEINT) AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * n AS cap, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY CAST(3 * n AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY CAST(3 * n AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s),
c AS (SELECT *, CAST(cap AS DOUBLE) * CAST(rest_w AS DOUBLE) <= CAST(w AS DOUBLE) * CAST(rest AS DOUBLE) AS full_ FROM r),
o AS (SELECT (SELECT sum(n) FROM s) - coalesce(sum(cap) FILTER (full_), 0) AS open_sum, sum(w) FILTER (NOT full_) AS open_w FROM c),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, CASE WHEN full_ THEN CAST(cap AS DOUBLE) ELSE CAST(w AS DOUBLE) * CAST(open_sum AS DOUBLE) / CAST(open_w AS DOUBLE) END AS target FROM c, o),
u AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM u)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before_)) AS BIGINT) AS taken FROM v
"""


OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) END)) AS sh FROM w),
c AS (SELECT sh, CASE WHEN len(sh) = 0 THEN doc_id END AS alone, min(doc_id) AS class, len(sh) AS n FROM s GROUP BY ALL),
u AS (SELECT class, n, unnest(sh) AS g FROM c),
p AS (SELECT x.class AS a, y.class AS b FROM u x JOIN u y ON x.g = y.g AND x.class < y.class GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT class AS d, class AS low FROM c UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.d),
m AS (SELECT d, min(low) AS low FROM r GROUP BY d)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.low AS component_id, s.doc_id = m.low AS kept
FROM s JOIN c ON s.sh = c.sh AND (c.alone IS NULL OR c.alone = s.doc_id) JOIN m ON m.d = c.class
"""

#: The plain prefix filter of single words; the operator's is of neighbour pairs.
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, i AS pos, list_distinct(regexp_extract_all({_LOW.format("l[i + 1]")}, '{_WORD}')) AS w FROM t, unnest(range(len(l))) r(i)),
c AS (SELECT list_sort(w) AS w, min((doc_id, pos)) AS low FROM l WHERE len(w) >= 1 GROUP BY 1),
k AS (SELECT g, count(*) AS n FROM (SELECT unnest(w) AS g FROM c) GROUP BY g),
o AS (SELECT low, w, g, row_number() OVER (PARTITION BY low ORDER BY n, g) AS place FROM (SELECT low, w, unnest(w) AS g FROM c) JOIN k USING (g)),
x AS (SELECT low, w, g FROM o WHERE place <= len(w) - CAST(ceil(len(w) * 4 / 5) AS BIGINT) + 1),
p AS (SELECT DISTINCT b.low AS later, a.w AS v, b.w AS w FROM x a JOIN x b ON a.g = b.g AND a.low < b.low AND len(a.w) * 5 >= len(b.w) * 4 AND len(b.w) * 5 >= len(a.w) * 4),
h AS (SELECT DISTINCT later FROM (SELECT later, len(v) + len(w) AS n, len(list_intersect(v, w)) AS i FROM p) WHERE 5 * i >= 4 * (n - i)),
g AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, list_sort(w) AS w FROM l) JOIN c USING (w) LEFT JOIN h ON h.later = c.low WHERE h.later IS NOT NULL OR (doc_id, pos) <> c.low),
z AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM g GROUP BY doc_id)
SELECT t.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed FROM t LEFT JOIN z USING (doc_id)
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, b[s + 1 : s + 50] AS g FROM d, unnest(range(greatest(octet_length(b) - 49, 0))) t(s)),
m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
x AS (SELECT w.doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY w.doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS apart FROM w JOIN m USING (g) WHERE low < w.doc_id),
r AS (SELECT doc_id, s, sum(apart) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM x),
p AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM r GROUP BY doc_id, run),
q AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, list_concat([0], list(z ORDER BY a)) AS begins, list(a ORDER BY a) AS ends FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, b, n_removed, n_spans, coalesce(begins, [0]) AS begins, list_concat(coalesce(ends, []), [octet_length(b)]) AS ends FROM d LEFT JOIN q USING (doc_id))
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(len(begins)), lambda i: CASE WHEN begins[i + 1] < ends[i + 1] THEN hex(b[begins[i + 1] + 1 : ends[i + 1]]) ELSE '' END), ''))) AS kept_sha256
FROM k
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(u) AS n, list_transform(range(4), lambda i: CAST('0x' || x[8 * i + 1 : 8 * i + 8] AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : low], '') AS p, array_to_string(u[low + 1 : high], '') AS m, array_to_string(u[high + 1 : n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def _near(books: str) -> str:
    return f"SELECT vec_id, part, any_value(x) AS x, min((list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e)) AS near FROM p JOIN {books} USING (part) GROUP BY vec_id, part"


def _moved(near: str, books: str) -> str:
    return f"""SELECT part, e, CASE WHEN n IS NULL THEN c ELSE list_transform(range(1, len(c) + 1), lambda i: (total[i] - (total[i] % n + n) % n) // n) END AS c FROM {books} LEFT JOIN (
  SELECT part, e, any_value(n) AS n, list(s ORDER BY d) AS total FROM (SELECT part, near[2] AS e, d, count(*) AS n, CAST(sum(x[d]) AS BIGINT) AS s FROM {near}, unnest(range(1, len(x) + 1)) t(d) GROUP BY ALL) GROUP BY part, e) USING (part, e)"""


OP13_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM k, unnest(range(16)) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p JOIN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64) USING (vec_id)),
a1 AS MATERIALIZED ({_near("b0")}), b1 AS MATERIALIZED ({_moved("a1", "b0")}),
a2 AS MATERIALIZED ({_near("b1")}), b2 AS MATERIALIZED ({_moved("a2", "b1")}),
a3 AS MATERIALIZED ({_near("b2")}),
r AS (SELECT vec_id, string_agg(format('{{:02x}}', near[2]), '' ORDER BY part) AS code, CAST(sum(near[1]) AS BIGINT) AS error FROM a3 GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256
FROM r JOIN k USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op4_license_scan": OP4_SQL, "op5_warc": OP5_SQL, "op6_mix": OP6_SQL, "op9_neardup": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_suffix_dedup": OP11_SQL, "op12_fim": OP12_SQL, "op13_vector_codes": OP13_SQL}
