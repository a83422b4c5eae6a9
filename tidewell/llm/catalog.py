"""The corpus queries, each over its whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontam, importance, langid, license_scan, line_dedup, mixing, near_dedup, quality, sharding, signature_tree, substring_dedup, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in_fold(parts: int, held: int) -> Column:
    """Whether crc32(doc_id as text) mod parts is held; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == held, F.lit(False))


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + 1 AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS key,
    substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1)::VARCHAR), 1, 3) AS bucket
  FROM documents),
g AS (SELECT key, sum(size)::BIGINT AS size FROM d GROUP BY key),
p AS (SELECT key, (sum(size) OVER (ORDER BY key))::BIGINT AS upto, size FROM g),
ladder AS (SELECT list_concat([0::BIGINT], list(upto ORDER BY upto)) AS sums, max(upto) AS total FROM p),
search AS (
  SELECT ceil(total / 16)::BIGINT AS low, total AS high, (ceil(total / 16)::BIGINT + total) // 2 AS mid, 0::BIGINT AS pos, 0 AS k FROM ladder
  UNION ALL
  SELECT low2, high2, CASE WHEN over THEN (low2 + high2) // 2 ELSE mid END, CASE WHEN over THEN 0 ELSE nxt END, CASE WHEN over THEN 0 ELSE k + 1 END
  FROM (
    SELECT *, CASE WHEN pos < total AND k = 16 THEN mid + 1 ELSE low END AS low2, CASE WHEN pos = total THEN mid ELSE high END AS high2
    FROM (SELECT search.*, total, pos = total OR k = 16 AS over, list_max(list_filter(sums, lambda x: x <= pos + mid)) AS nxt FROM search, ladder WHERE low < high)
  )),
cap AS (SELECT min(high) AS c FROM search WHERE low >= high),
far AS (
  SELECT 0 AS k, 0::BIGINT AS f UNION ALL
  SELECT k + 1, list_max(list_filter(sums, lambda x: x <= least(f + c, total))) FROM far, cap, ladder WHERE k < 16),
near AS (
  SELECT 16 AS k, total AS b FROM ladder UNION ALL
  SELECT k - 1, list_min(list_filter(sums, lambda x: x >= greatest(b - c, 0))) FROM near, cap, ladder WHERE k > 0),
cut AS (
  SELECT 0 AS k, 0::BIGINT AS pos UNION ALL
  SELECT k, least(greatest(CASE WHEN share - below <= above - share THEN below ELSE above END, low), high)
  FROM (
    SELECT cut.k + 1 AS k, (cut.k + 1) * total // 16 AS share, greatest(near.b, pos) AS low, least(far.f, list_max(list_filter(sums, lambda x: x <= least(pos + c, total)))) AS high,
      list_max(list_filter(sums, lambda x: x <= (cut.k + 1) * total // 16)) AS below, list_min(list_filter(sums, lambda x: x >= (cut.k + 1) * total // 16)) AS above
    FROM cut, cap, ladder, near, far WHERE cut.k < 15 AND near.k = cut.k + 1 AND far.k = cut.k + 1
  )),
crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
h AS (SELECT doc_id, key, size, bucket, text, string_split(hex(encode(text)), '') AS x FROM d),
b AS (SELECT doc_id, key, size, bucket, text, CASE WHEN size = 1 THEN []::BIGINT[] ELSE list_transform(range(1, len(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i]) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 17)::BIGINT) END AS bytes FROM h),
s AS (
  SELECT doc_id, b.size, key, bucket, CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) END AS text_crc32,
    (SELECT count(*) FROM cut WHERE cut.k > 0 AND p.upto - p.size >= cut.pos)::INTEGER AS shard
  FROM b JOIN p USING (key), crc)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, key, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
"""


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", _in_fold(4, 2).alias("held_out"))
    net = langid.fit(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return langid.identify(docs, net, ["doc_id", "held_out"])


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, i, ls[i] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE regexp_matches(ls[i], '[^\x20\x09-\x0D]')),
v AS (
  SELECT doc_id, n, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c, words AS x, lead(words) OVER d AS y
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l) WINDOW d AS (PARTITION BY doc_id ORDER BY n)),
w AS (SELECT * FROM (SELECT doc_id, n, a, CASE WHEN x >= 25 THEN 1 WHEN x + y >= 25 THEN 2 WHEN c IS NOT NULL THEN 3 END AS k, CASE WHEN k > 1 THEN b END AS b, CASE WHEN k > 2 THEN c END AS c FROM v) WHERE k IS NOT NULL),
f AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(n) OVER o AS n0 FROM w WINDOW o AS (PARTITION BY k, a, b, c ORDER BY doc_id, n)),
g AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(n, n0 + k) ELSE n END, n + k)) AS n
  FROM f WHERE doc_id <> d0 OR n <> n0),
k AS (
  SELECT d.doc_id, d.text, d.ls, list(l.i) FILTER (WHERE g.n IS NOT NULL) AS gone, count(l.n) AS n_lines, count(g.n) AS n_removed
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents) d LEFT JOIN l USING (doc_id) LEFT JOIN g ON g.doc_id = l.doc_id AND g.n = l.n GROUP BY d.doc_id, d.text, d.ls),
t AS (
  SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i] || CASE WHEN i < len(ls) THEN chr(10) ELSE '' END), '') END AS t
  FROM k)
SELECT doc_id, n_lines, n_removed, CASE WHEN t = '' THEN 0 ELSE length(t) END::BIGINT AS clean_chars, md5(t) AS clean_md5
FROM t
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.shared_passages(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a, min(b) AS component FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component, w.doc_id) AS component_id, coalesce(m.component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n) AS rows, sum(pow(n, 0.5)) AS shares FROM c),
r AS (SELECT source, pow(n, 0.5) * (rows::DOUBLE / shares) / n AS rate FROM c, t),
m AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 16), 1) AS mean FROM r),
f AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM m UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM f WHERE k < 72),
l AS (SELECT source, list(c ORDER BY k) AS cdf FROM f GROUP BY source),
n AS (
  SELECT d.*, concat_ws(':', coalesce(d.doc_id::VARCHAR, ''), md5(d.text)) AS name, m.rate AS mix_rate,
    list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('tidewell:' || name || ':' || j::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496))))::BIGINT AS mix_copies
  FROM documents d JOIN m ON d.source IS NOT DISTINCT FROM m.source JOIN l ON l.source IS NOT DISTINCT FROM m.source),
e AS (SELECT *, unnest(range(1, mix_copies + 1)) AS mix_replica FROM n WHERE mix_copies > 0)
SELECT * EXCLUDE (name), ('0x' || substr(md5('tidewell:' || name || ':' || mix_replica::VARCHAR || ':order'), 1, 15))::BIGINT AS mix_key
FROM e
"""


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    def canonical(text: str) -> str:
        out = f"regexp_replace(regexp_replace({text}, '{license_scan.COPYRIGHT_LINE}', '', 'g'), '{license_scan.LIST_MARK}', '', 'g')"
        out = f"' ' || regexp_replace(translate({out}, '{license_scan.UPPER}', '{license_scan.LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\x{{00A0}}-\\x{{00BF}}\\x{{2010}}-\\x{{2027}}]+', ' ', 'g') || ' '"
        for one, other in license_scan.SPELLINGS:
            out = f"replace({out}, '{one}', '{other}')"
        return f"trim(regexp_replace({out}, '  +', ' ', 'g'), ' ')"

    digests = "".join(f" UNION ALL SELECT '{d}', '{i}'" for i, d in license_scan.KNOWN_DIGESTS)
    quoted = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in license_scan.KNOWN)
    return f"""
WITH k AS (SELECT sha256({canonical("t")}) AS digest, min(i) AS license_id FROM (VALUES {quoted}) AS v(i, t) GROUP BY 1{digests}),
d AS (SELECT doc_id, {canonical("text")} AS form FROM documents)
SELECT doc_id, coalesce(length(form), 0)::BIGINT AS canonical_chars, CASE WHEN form <> '' THEN sha256(form) END AS digest, license_id
FROM d LEFT JOIN k ON form <> '' AND sha256(form) = k.digest
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", _in_fold(3, 1).alias("held_out"))
    scorer = toxicity.fit(docs.where("NOT held_out"), _table(spark, sf_dir, "labels").where(~_in_fold(3, 1)))
    scored = toxicity.score(docs, scorer, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.length("clean_text").cast("long").alias("clean_chars"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, string_split(t, chr(10)) AS all_lines FROM d),
x AS (SELECT rid, i, hash(list_slice(ws, i, i + 7)) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
y AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM x) WHERE n > 1),
z AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM y) GROUP BY rid),
good AS (
  SELECT rid, list_filter(all_lines, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR (
    greatest(length(x) - length(translate(x, '#*$%&|<>', '')), length(x) - length(replace(x, '!!', ''))) * 100 <= length(x) * 10
    AND regexp_matches(x, '[.!?\x{2026}\x{3002}][''")\]\x{00BB}\x{201D}\x{2019}]*([\x20\x09-\x0D]|\z)')
    AND NOT (regexp_matches(x, '{NAVIGATION}') OR (regexp_matches(x, '{SEPARATED}') AND NOT regexp_matches(x, '{QUOTED}') AND NOT regexp_matches(x, '{CLOSED}')))
    AND NOT (regexp_matches(x, '{BOILERPLATE}') AND (length(x) - length(regexp_replace(x, '{BOILERPLATE}', '', 'g'))) * 100 > length(x) * 15))) AS good
  FROM w),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', ''))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(z.n, 0)::BIGINT AS n_repeat_words,
    length(array_to_string(lines, '')) AS before, length(array_to_string(list_filter(good, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), '')) AS after, length(array_to_string(good, chr(10))) AS clean_chars
  FROM w LEFT JOIN z USING (rid) JOIN good USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (before - after) * 100 <= before * 50 AS kept, coalesce(clean_chars, 0)::BIGINT AS clean_chars
FROM v
"""
for _name in ("NAVIGATION", "SEPARATED", "QUOTED", "CLOSED", "BOILERPLATE"):
    OP9_SQL = OP9_SQL.replace("{" + _name + "}", getattr(quality, _name).replace("'", "''"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS rid
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT rid, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
m AS (SELECT DISTINCT dw.rid, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
n AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY rid)
SELECT w.doc_id, coalesce(len(w.ws), 0)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (rid) LEFT JOIN n USING (rid)
"""


def op11_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return signature_tree.similar_documents(_table(spark, sf_dir, "documents"), words=3, percent=90)


OP11_SQL = OP5_SQL.replace(">= 85 *", ">= 90 *").replace(", coalesce(m.component, w.doc_id) = w.doc_id AS kept", "")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 16 parts, 64 entries, 2 rounds."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE k AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM k, range(16) AS t(p)),
e0 AS (SELECT p, r - 1 AS e, x AS y FROM p WHERE r <= 64),
a0 AS (SELECT r, p, x, min({'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m FROM p JOIN e0 USING (p) GROUP BY ALL),
e1 AS (SELECT p, e, coalesce(n.y, e0.y) AS y FROM e0 LEFT JOIN (
  SELECT p, e, list(s ORDER BY i) AS y FROM (SELECT p, m.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS s FROM a0, range(1, 1025) AS t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY ALL) n USING (p, e)),
a1 AS (SELECT r, p, x, min({'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m FROM p JOIN e1 USING (p) GROUP BY ALL),
e2 AS (SELECT p, e, coalesce(n.y, e1.y) AS y FROM e1 LEFT JOIN (
  SELECT p, e, list(s ORDER BY i) AS y FROM (SELECT p, m.e AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS s FROM a1, range(1, 1025) AS t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY ALL) n USING (p, e)),
a2 AS (SELECT r, p, min({'d': list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}) AS m FROM p JOIN e2 USING (p) GROUP BY ALL),
c AS (SELECT r, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM e2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM k JOIN c USING (r), h
"""


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents towards the distribution of the benchmark's words."""
    return importance.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT w, string_split(hex(encode(w)), '') AS x FROM (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw))),
y AS (SELECT w, list_transform(range(1, len(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i]) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 17)::BIGINT) AS bytes FROM x),
b AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1]))) % 10000 AS b FROM y, crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN b USING (w) GROUP BY b),
g AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT count(*) FROM dw)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT count(*) FROM bw)::DOUBLE + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT b FROM b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
v AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (b) GROUP BY r),
o AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN v USING (r)),
k AS (SELECT 10 * count(*) // 100 AS k FROM o WHERE n_features >= 20),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= k THEN place END AS rank
FROM q, k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_shard": op1_shard,
        "op2_language": op2_language,
        "op3_line_dedup": op3_line_dedup,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_near_dedup": op5_near_dedup,
        "op6_mix": op6_mix,
        "op7_license": op7_license,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_decontaminate": op10_decontaminate,
        "op11_similar": op11_similar,
        "op12_vector_codes": op12_vector_codes,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_shard": OP1_SQL,
        "op3_line_dedup": OP3_SQL,
        "op5_near_dedup": OP5_SQL,
        "op6_mix": OP6_SQL,
        "op7_license": _license_sql(),
        "op9_quality": OP9_SQL,
        "op10_decontaminate": OP10_SQL,
        "op11_similar": OP11_SQL,
        "op12_vector_codes": OP12_SQL,
        "op13_importance": OP13_SQL,
    }
