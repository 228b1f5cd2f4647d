"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_layout, merkle, minhash, mixing, ring_shard, secrets, sort_means, subwords, suffix_dedup, telephony, toxicity, url_cascade


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents have no path; the source is what they say of where a text comes from
    return secrets.scan_all(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path_col="source")


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_layout.extract(_table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"), "text")


ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_cascade.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), ALLOW, BLOCK)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ring_shard.measured(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    placed = ring_shard.assign(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs)
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs)
    return out.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "place")


def op8_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    media = telephony.decode_media(telephony.encode_texts(docs))
    return media.withColumns({"pcm_bytes": F.octet_length("pcm").cast("long"), "pcm_sha256": F.sha2("pcm", 256)}).drop("pcm")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.prove(_table(spark, sf_dir, "documents"), claims=merkle.counted_up())
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(_table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = subwords.fit(docs, _table(spark, sf_dir, "labels"))
    return subwords.score(docs, model).select("doc_id", subwords.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_secrets, op3_html_layout, op4_url_cascade, op5_ring_shards, op6_suffix_dedup, op7_temperature_mix, op8_telephony, op9_minhash, op10_toxicity, op11_merkle, op12_sort_means, op13_quality)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_decontamination": rf"""
WITH bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS t,
        least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM dw, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT g.doc_id, g.i, g.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM grams) g JOIN win USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_url_cascade": r"""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (SELECT s.page_id, r.rule, r.verdict FROM split s, rules r
        WHERE (s.host = split_part(r.rule, '/', 1) OR ends_with(s.host, '.' || split_part(r.rule, '/', 1)))
          AND starts_with(s.path, substr(r.rule, instr(r.rule, '/')))),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (page_id)""",
    "op7_temperature_mix": r"""
WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
tot AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY source),
ends AS (SELECT min(tokens) FILTER (tokens > 0)::DOUBLE AS lo_t, max(tokens)::DOUBLE AS hi_t FROM tot),
bis AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, lo_t, hi_t FROM ends
  UNION ALL
  SELECT k + 1, CASE WHEN pow(lo_t / hi_t, (lo + hi) / 2 - 1) > 1.5 THEN (lo + hi) / 2 ELSE lo END,
         CASE WHEN pow(lo_t / hi_t, (lo + hi) / 2 - 1) > 1.5 THEN hi ELSE (lo + hi) / 2 END, lo_t, hi_t FROM bis WHERE k < 60),
a AS (SELECT CASE WHEN pow(lo_t / hi_t, -1) <= 1.5 THEN 0.0 ELSE hi END AS a, hi_t FROM bis WHERE k = 60),
plan AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / hi_t, a) ELSE 0 END AS p,
         CASE WHEN tokens > 0 THEN floor(tokens * pow(tokens / hi_t, a - 1))::BIGINT ELSE 0 END AS take FROM tot, a),
w AS (SELECT *, p / (SELECT sum(p) FROM plan) AS weight FROM plan),
passes AS (SELECT t.*, w.tokens, w.take, w.weight, unnest(range(0, CASE WHEN tokens > 0 THEN ceil(take / tokens)::INT ELSE 1 END))::INT AS epoch
           FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source),
placed AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || '#' || epoch::VARCHAR), 1, 15))::BIGINT AS place FROM passes),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
ranges AS (SELECT source, epoch, r, sum(s) OVER (PARTITION BY source, epoch ORDER BY r) - s AS begins
           FROM (SELECT source, epoch, place >> 52 AS r, sum(n_tokens) AS s FROM placed GROUP BY ALL))
SELECT doc_id, summed.source, n_tokens, round(weight, 6) AS weight, summed.epoch, place,
       CASE WHEN take > 0 THEN least(floor((summed.epoch * tokens + begins) * 64 / take), 63)::INT ELSE 0 END AS block
FROM summed JOIN ranges ON summed.source IS NOT DISTINCT FROM ranges.source AND summed.epoch = ranges.epoch AND place >> 52 = r
WHERE tokens = 0 OR upto <= take - summed.epoch * tokens""",
    "op11_merkle": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, coalesce(lang, '') AS l, lang IS NOT NULL AS has, doc_id::VARCHAR AS i FROM documents),
marked AS (SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(i) + 1), lambda k: ascii(i[k])::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 7 = 0, false) AS forged FROM d, crc),
leaves AS (SELECT doc_id, l, has, forged, n_chars,
  coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
  coalesce(strlen(text) || ':' || text, '-') AS back FROM marked),
hashed AS (SELECT doc_id, l, has, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
  sha256(front || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + forged::INT)::VARCHAR) || ':' || (n_chars + forged::INT) END || back) AS claim FROM leaves),
ranked AS (SELECT *, row_number() OVER (PARTITION BY has, l ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
tree AS (SELECT has, l, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM ranked GROUP BY has, l
  UNION ALL SELECT has, l, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM tree WHERE len(nodes) > 1),
subs AS (SELECT has, l, nodes[1] AS subroot, row_number() OVER (ORDER BY has, encode(l)) - 1 AS g FROM tree WHERE len(nodes) = 1),
upper AS (SELECT 0 AS level, list(subroot ORDER BY g) AS nodes FROM subs
  UNION ALL SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda k: sha256(nodes[k] || coalesce(nodes[k + 1], ''))) FROM upper WHERE len(nodes) > 1),
depth AS (SELECT has, l, max(level) AS h FROM tree GROUP BY has, l),
steps AS (
  SELECT has, l, level, unnest(range(len(nodes))) AS spot, nodes, -1 AS g FROM tree WHERE len(nodes) > 1
  UNION ALL SELECT s.has, s.l, h + u.level, -1, u.nodes, s.g FROM upper u, subs s JOIN depth USING (has, l) WHERE len(u.nodes) > 1),
way AS (SELECT has, l, level, spot, CASE WHEN g < 0 THEN spot ELSE g >> (level - h) END AS own, nodes FROM steps JOIN depth USING (has, l)),
step AS (SELECT has, l, level, spot, own % 2 = 1 AS l_side, nodes[xor(own, 1) + 1] AS sibling FROM way),
fold AS (SELECT has, l, pos, 0 AS level, claim AS node, '' AS proof FROM ranked
  UNION ALL SELECT f.has, f.l, f.pos, f.level + 1, sha256(CASE WHEN l_side THEN sibling || node ELSE node || coalesce(sibling, '') END), proof || coalesce(sibling, '')
  FROM fold f JOIN step s ON f.has = s.has AND f.l = s.l AND f.level = s.level AND (s.spot = -1 OR s.spot = f.pos >> f.level)),
done AS (SELECT has, l, pos, arg_max(node, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY ALL),
whole AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked JOIN subs USING (has, l) JOIN done USING (has, l, pos), whole""",
    "op12_sort_means": """
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 1048576)) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept ORDER BY c LIMIT 16),""",
}

_ASSIGN = """
a{0} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - o.v[i]) * (k.v[i] - o.v[i])))::BIGINT AS d FROM kept k, c{0} o) GROUP BY r),"""
_MOVE = """
s{0} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{0} JOIN kept USING (r)) GROUP BY c, i),
m{0} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{0} GROUP BY c),
c{1} AS (SELECT c, coalesce(m{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN m{0} USING (c)),"""
ORACLE["op12_sort_means"] += "".join(_ASSIGN.format(k) + _MOVE.format(k, k + 1) for k in range(3)) + _ASSIGN.format(3).rstrip(",") + """
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN c3 USING (c)"""
