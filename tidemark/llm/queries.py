"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, codebooks, decontamination, licenses, merkle, minhash, quality, rotation, sharding, suffixes, token_counts, toxicity, warc
from .common import table
from .labels import held_out

SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 4099


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.scan_documents(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_rotation_codes": op2_rotation_codes,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op8_suffixes": op8_suffixes,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op7_warc": op7_warc,
    "op11_codebooks": op11_codebooks,
    "op12_merkle": op12_merkle,
    "op13_licenses": op13_licenses,
}

_FOLD = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SIZED = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _nearest(books: str) -> str:
    """SQL for the nearest entry of each part: least distance, lower index where equal."""
    return f"SELECT p.r, p.part, min((list_dot_product(c.v, c.v) - 2 * list_dot_product(p.v, c.v))::HUGEINT * 256 + c.i) & 255 AS i FROM p JOIN {books} c ON c.part = p.part GROUP BY p.r, p.part"


def _round(k: int) -> str:
    """SQL for one round of assigning all parts and moving the entries."""
    return f"""a{k} AS ({_nearest(f'c{k}')}),
m{k} AS (SELECT part, i, list(floor(s / n)::DOUBLE ORDER BY j) AS v FROM (
  SELECT part, i, j, sum(v[j]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part), range(1, {{q}} + 1) t(j) GROUP BY part, i, j) GROUP BY part, i),
c{k + 1} AS (SELECT part, i, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (part, i)),
""".replace("{q}", "(SELECT max(len(v)) FROM p)")


ORACLES = {
    "op11_codebooks": f"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id, e) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS (SELECT r, part, e[part * len(e) // 4 + 1:(part + 1) * len(e) // 4] AS v FROM k, range(4) t(part)),
c0 AS (SELECT part, r - 1 AS i, v FROM p WHERE r <= 256),
{''.join(_round(k) for k in range(4))}
z AS ({_nearest('c4')}),
x AS (SELECT r, string_agg(printf('%02x', z.i), '' ORDER BY part) AS code, sum(list_dot_product(list_transform(p.v, lambda y, n: y - c4.v[n]), list_transform(p.v, lambda y, n: y - c4.v[n])))::BIGINT AS error
  FROM z JOIN p USING (r, part) JOIN c4 ON c4.part = p.part AND c4.i = z.i GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda y: y::BIGINT), ','), ',' ORDER BY part, i)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN x USING (r), h""",
    "op2_rotation_codes": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r(node, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = vec_id AS kept
FROM embeddings JOIN (SELECT node AS vec_id, min(c) AS c FROM r GROUP BY node) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)""",
    "op9_minhash": """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents JOIN (SELECT node AS doc_id, min(c) AS c FROM r GROUP BY node) USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_sharding": f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 2, '0') || '/offset'), 1, 15))::BIGINT % {SLOTS} AS o,
    ('0x' || substr(md5('shard-' || lpad(i::VARCHAR, 2, '0') || '/skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS s
  FROM range({len(SHARDS)}) t(i)
), prefs AS (SELECT list(o ORDER BY i) AS os, list(s ORDER BY i) AS ss FROM shards),
fill(turn, taken, slot) AS (
  SELECT 0::BIGINT, list_transform(range({SLOTS}), lambda x: false), -1::BIGINT
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(taken[1:p], [true]), taken[p + 2:]), p FROM (
    SELECT turn, taken, list_extract(list_filter(list_transform(range({SLOTS}), lambda j: (os[turn % {len(SHARDS)} + 1] + j * ss[turn % {len(SHARDS)} + 1]) % {SLOTS}), lambda q: NOT taken[q + 1]), 1) AS p
    FROM fill, prefs WHERE turn < {SLOTS}
  )
)
SELECT doc_id, f.slot, s.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN (SELECT turn - 1 AS turn, slot FROM fill WHERE turn > 0) f ON f.slot = d.slot
JOIN shards s ON s.i = f.turn % {len(SHARDS)}""",
    "op6_decontamination": f"""
WITH i AS (
  SELECT item_id::VARCHAR AS item, {_FOLD.format('text')} AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item, len(g) AS size, array_to_string(g, ' ') AS gram FROM (
    SELECT item, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda k: w[k + 1:k + 10])) AS g FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM win),
d AS (SELECT doc_id, coalesce({_FOLD.format('text')}, []) AS w FROM documents),
grams AS (
  SELECT doc_id, size, unnest(range(greatest(len(w) - size + 1, 0))) AS k, w FROM d, sizes
), hits AS (
  SELECT g.doc_id, g.k, g.size, win.item FROM (SELECT doc_id, size, k, array_to_string(w[k + 1:k + size], ' ') AS gram FROM grams) g
  JOIN win USING (size, gram)
), agg AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT b, max(page_id) AS top, count(*) AS n FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.b = g.b""",
    "op12_merkle": f"""
WITH RECURSIVE c AS (
  SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS k,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(4294967295, list_reduce(flatten(list_transform(range(len(doc_id::VARCHAR)), lambda i: [unicode(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT)) AS crc
  FROM documents
), d AS (
  SELECT row_number() OVER () AS r, doc_id, k, leaf, CASE WHEN crc % 3 = 0 THEN sha256(head || {_SIZED.format('low')}) ELSE leaf END AS tried,
    row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT *, sha256(head || {_SIZED.format('text')}) AS leaf FROM (SELECT *, {' || '.join(map(_SIZED.format, ('doc_id', 'source', 'lang', 'n_chars')))} AS head FROM c))
), up(k, lv, pos, h, n) AS (
  SELECT k, 0, pos, leaf, n FROM d
  UNION ALL SELECT k, lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY k, lv, pos // 8, n
), sub AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lv, pos, h, n) AS (
  SELECT 0, pos, h, n FROM sub
  UNION ALL SELECT lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lv, pos // 8, n
), runs AS (SELECT k, lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY k, lv, pos // 8),
high AS (SELECT lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY lv, pos // 8),
steps AS (
  SELECT r, lv AS step, hs, d.pos // (8 ** lv)::BIGINT % 8 AS p FROM d JOIN runs ON runs.k = d.k AND runs.run = d.pos // (8 ** (lv + 1))::BIGINT
  UNION ALL SELECT r, 1000 + lv, hs, sub.pos // (8 ** lv)::BIGINT % 8 FROM d JOIN sub USING (k) JOIN high ON high.run = sub.pos // (8 ** (lv + 1))::BIGINT
), ways AS (
  SELECT r, list(array_to_string(hs[1:p], '') || '|' || array_to_string(hs[p + 2:], '') ORDER BY step) AS way FROM steps GROUP BY r
), tried AS (
  SELECT d.*, sub.h AS subroot, top.h AS root, coalesce(way, []) AS way,
    list_reduce(coalesce(way, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), tried) AS folded_root
  FROM d JOIN sub USING (k) JOIN top ON top.n = 1 LEFT JOIN ways USING (r)
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM tried""",
}
