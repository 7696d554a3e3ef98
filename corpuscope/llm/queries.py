"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import ann, bpe, conversation, decontamination, fingerprint, langid, mixing, neardup, pii, resampling, suffix_dedup, token_count, url_filter

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.in_training(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~langid.in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"), with_text=False)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, keep=("doc_id",), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.count_tokens(table(spark, sf_dir, "documents"), path, keep=("doc_id",), limit=512)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.written(F.col("sketch")).alias("fingerprint"),
        fingerprint.written(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of their id and turn deals out: rows dropped, emptied, unpunctuated, repeated or said by the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repaired, _ = conversation.repair(damaged(rows), with_turns=False)
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    out = every.join(repaired, F.col("conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, least_words=20, percent=10, seed=2024)


_SQL3 = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS s,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
            / greatest(0.25::DOUBLE, least(1.0::DOUBLE, size / 100.0::DOUBLE)) AS key
  FROM d
), t AS (
  SELECT sn, s, sum(size)::BIGINT AS source_size FROM d GROUP BY sn, s
), w AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY sn, s) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 3 AS cap FROM t
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / w, sn, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS best FROM l WHERE level * w <= cap ORDER BY cap / w, sn, s LIMIT 1
), g AS (
  SELECT sn, s, source_size, least(cap::DOUBLE, best * w) AS target FROM l, f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)::BIGINT) ELSE 0 END AS epochs FROM g
), r AS (
  SELECT doc_id, size, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY sn, s ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM k JOIN e USING (sn, s)
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN rest > 0 AND before + size / 2 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

_SQL7 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT h.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.host) + length(r.path) DESC) AS n
  FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)
)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.n = 1
"""


#: Windows of 100 bytes as hexadecimal digits, cut from blocks of 1000 bytes.
_SQL2 = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents
), b AS (
  SELECT doc_id, n, k, substr(h, k * 2000 + 1, 2198) AS block FROM (SELECT *, unnest(range(0, (n + 999) // 1000)) AS k FROM d)
), w AS (
  SELECT doc_id, k * 1000 + i AS pos, md5_number(substr(block, i * 2 + 1, 200)) AS key FROM (SELECT *, unnest(range(0, least(1000, n - 99 - k * 1000))) AS i FROM b)
), r AS (
  SELECT doc_id, pos FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1
), m AS (
  SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100, true)::INT AS fresh FROM r
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM m
), s AS (
  SELECT doc_id, span, min(pos) AS a, max(pos) + 100 AS z FROM g GROUP BY ALL
), p AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), c AS (
  SELECT p.doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans, string_agg(substr(h, before * 2 + 1, (a - before) * 2), '' ORDER BY a) || substr(any_value(h), max(z) * 2 + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""

#: All inner products; the search finds the same neighbours on small tables, where a block's verified vectors are most of it.
_SQL5 = """
WITH v AS (
  SELECT vec_id, min(embedding) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e::DOUBLE[], v.e::DOUBLE[]) AS score FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

_SQL8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), items AS (
  SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT doc_id, len(s) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept FROM sets JOIN reach ON a = doc_id GROUP BY doc_id, s
"""

_SQL11 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (
  SELECT row_number() OVER () AS row, doc_id, w, len(w) AS n FROM w
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), r AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1), lambda s: array_to_string(w[s : s + 9], ' '))) AS run FROM i
), l AS (
  SELECT DISTINCT m FROM r
), o AS (
  SELECT row, m, s, array_to_string(w[s : s + m - 1], ' ') AS run FROM (SELECT row, w, m, unnest(range(1, n - m + 2)) AS s FROM d, l WHERE n >= m)
), h AS (
  SELECT row, s, o.m, run, item_id FROM o JOIN r USING (run)
), c AS (
  SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, unnest(range(s, s + m)) AS k FROM h) GROUP BY row
), t AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY row
)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN t USING (row)
"""

#: The table of checksums by byte, as a list.
_CRC = """crc AS (
  SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(b))
)"""


def _crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, where crc is in scope."""
    byte = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), i * 2 + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


#: Row by row, for each state the cheapest and least edits that lead to it; two ways of one cost are never a prefix of each other.
_SQL12 = rf"""
WITH RECURSIVE {_CRC}, o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS draw FROM conversations, crc
), g AS (
  SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM o WHERE draw <> 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM g
), f AS (
  SELECT *, left(role, 1) AS r, coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM n
), e AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal, max(n) AS last
  FROM f GROUP BY conv_id
), way AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS o, {{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s, {{'c': 3::BIGINT, 'a': 'I', 't': ['user:']}} AS u, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS a FROM e
  UNION ALL
  SELECT conv_id, n, o, s, u, list_min([a, {{'c': u.c + 3, 'a': u.a || 'I', 't': list_append(u.t, 'assistant:')}}]) AS a FROM (
    SELECT conv_id, n, o, s, list_min([u, {{'c': o.c + 3, 'a': o.a || 'I', 't': list_append(o.t, 'user:')}}, {{'c': s.c + 3, 'a': s.a || 'I', 't': list_append(s.t, 'user:')}}, {{'c': a.c + 3, 'a': a.a || 'I', 't': list_append(a.t, 'user:')}}]) AS u, a FROM (
      SELECT conv_id, n,
        {{'c': o.c + 4, 'a': o.a || 'D', 't': o.t}} AS o,
        list_min([{{'c': s.c + 4, 'a': s.a || 'D', 't': s.t}}, {{'c': o.c + ks, 'a': o.a || 'K', 't': list_append(o.t, said)}}]) AS s,
        list_min([{{'c': u.c + 4, 'a': u.a || 'D', 't': u.t}}, {{'c': o.c + ku, 'a': o.a || 'K', 't': list_append(o.t, said)}}, {{'c': s.c + ku, 'a': s.a || 'K', 't': list_append(s.t, said)}}, {{'c': a.c + ku, 'a': a.a || 'K', 't': list_append(a.t, said)}},
                  {{'c': o.c + kr, 'a': o.a || 'R', 't': list_append(o.t, 'user:' || text)}}, {{'c': s.c + kr, 'a': s.a || 'R', 't': list_append(s.t, 'user:' || text)}}, {{'c': a.c + kr, 'a': a.a || 'R', 't': list_append(a.t, 'user:' || text)}}]) AS u,
        list_min([{{'c': a.c + 4, 'a': a.a || 'D', 't': a.t}}, {{'c': u.c + ka, 'a': u.a || 'K', 't': list_append(u.t, said)}}, {{'c': u.c + kr, 'a': u.a || 'R', 't': list_append(u.t, 'assistant:' || text)}}]) AS a
      FROM (
        SELECT way.conv_id, f.n, o, s, u, a, text, role || ':' || text AS said, base + CASE r WHEN 's' THEN 0 ELSE 1000000000 END AS ks, base + CASE r WHEN 'u' THEN 0 ELSE 1000000000 END AS ku, base + CASE r WHEN 'a' THEN 0 ELSE 1000000000 END AS ka, base + 3 AS kr
        FROM way JOIN (SELECT *, CASE fault WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1000000000 END AS base FROM f) AS f ON f.conv_id IS NOT DISTINCT FROM way.conv_id AND f.n = way.n + 1
      )
    )
  )
), best AS (
  SELECT e.*, list_min([o, a]) AS w FROM way JOIN e ON e.conv_id IS NOT DISTINCT FROM way.conv_id AND n = last
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost,
  coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS d LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM d.conv_id
"""

_SQL13 = rf"""
WITH {_CRC}, d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), f AS (
  SELECT row, w, count(*) AS n FROM (SELECT row, unnest(w) AS w FROM d) GROUP BY row, w
), v AS (
  SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM i), crc
), s AS (
  SELECT bucket, sum(n) AS s FROM f JOIN v USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM i JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (tt + 10000.0::DOUBLE))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), (SELECT coalesce(sum(s), 0) AS ss FROM s), (SELECT coalesce(sum(t), 0) AS tt FROM t)
), m AS (
  SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM f JOIN v USING (w) JOIN g USING (bucket) GROUP BY row
), k AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS gumbel
  FROM d LEFT JOIN m USING (row)
), p AS (
  SELECT doc_id, n_features, weight, weight + gumbel AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + gumbel DESC, doc_id NULLS FIRST, n_features) END AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM k
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [n for n in globals() if n.startswith("op")]
    return {n: globals()[n] for n in sorted(names, key=lambda n: int(n[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": _SQL2, "op3_mixing": _SQL3, "op5_ann": _SQL5, "op7_url_filter": _SQL7, "op8_near_dedup": _SQL8, "op11_decontamination": _SQL11, "op12_conversation_repair": _SQL12, "op13_resampling": _SQL13}
