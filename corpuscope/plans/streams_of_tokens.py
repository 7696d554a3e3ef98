"""Queries over the token stream of the whole corpus: training windows, packed windows and binary shards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import packing, token_stream
from corpuscope.operators.cut import shared_folder
from corpuscope.registry import query, table
from corpuscope.sources.shards import Shards

WINDOW, SHARD, PACK = 128, 65_536, 4096

_TOKENS = r"""
d AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: ('0x' || substr(md5(w), 1, 4))::INT % 65535 + 1), 0) AS ids FROM documents WHERE regexp_matches(text, '\S')),
s AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos, count(*) OVER () AS n FROM (SELECT doc_id, unnest(ids) AS id, unnest(range(len(ids))) AS i FROM d))"""


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Documents that aren't blank, and their tokens."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    return docs, token_stream.token_ids(text.word_tokens(F.col("text")))


def _digest(tokens: str) -> Column:
    return F.sha2(F.array_join(F.transform(tokens, lambda x: x.cast("string")), ",").cast("binary"), 256)


@query(f"""
WITH {_TOKENS}, c AS (SELECT *, floor(n * 0.95::DOUBLE)::BIGINT AS cut FROM s), h AS (SELECT *, CASE WHEN (n - cut) // {WINDOW} > 0 THEN cut ELSE 0 END AS lo, CASE WHEN (n - cut) // {WINDOW} > 0 THEN n ELSE cut END AS hi FROM c),
p AS (SELECT 'train' AS part, id, pos, cut AS size FROM h WHERE pos < cut UNION ALL SELECT 'eval', id, pos - lo, hi - lo FROM h WHERE pos >= lo AND pos < hi),
w AS (SELECT part, id, pos, size, pos // {WINDOW} AS win FROM p UNION ALL SELECT part, id, pos, size, pos // {WINDOW} - 1 FROM p WHERE pos % {WINDOW} = 0 AND pos > 0),
l AS (SELECT part, win, list(id ORDER BY pos) AS ids FROM w WHERE win < size // {WINDOW} GROUP BY part, win)
SELECT part, win, len(ids) - 1 AS n, sha256(array_to_string(ids[:len(ids) - 1], ',')) AS inputs_sha256, sha256(array_to_string(ids[2:], ',')) AS labels_sha256 FROM l""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 tokens over the stream of all documents, cut at 95 hundredths, as digests of inputs and labels."""
    docs, tokens = _documents(spark, sf_dir)
    stream = token_stream.streamed(docs, "doc_id", tokens)
    rows = token_stream.training_windows(stream, token_stream.length(stream), WINDOW)
    return rows.select("part", "win", F.size("inputs").cast("long").alias("n"), _digest("inputs").alias("inputs_sha256"), _digest("labels").alias("labels_sha256"))


@query(f"""
WITH {_TOKENS}, c AS (SELECT id, pos, floor(n * 0.9::DOUBLE)::BIGINT AS c1, floor(n * (0.9::DOUBLE + (1 - 0.9::DOUBLE) / 2))::BIGINT AS c2 FROM s),
p AS (SELECT CASE WHEN pos < c1 THEN 'train' WHEN pos < c2 THEN 'val' ELSE 'test' END AS part, id, pos - CASE WHEN pos < c1 THEN 0 WHEN pos < c2 THEN c1 ELSE c2 END AS pos FROM c)
SELECT part, pos // {SHARD} AS shard, count(*) AS n, sha256(unhex(string_agg(lpad(hex(id % 256), 2, '0') || lpad(hex(id // 256), 2, '0'), '' ORDER BY pos))) AS sha256 FROM p GROUP BY ALL""")
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream as files of 16-bit tokens in the shared folder, cut at 90, 5 and 5 hundredths, and what is read back from them."""
    docs, tokens = _documents(spark, sf_dir)
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    spark.dataSource.register(Shards)
    stream = token_stream.streamed(docs, "doc_id", tokens)
    token_stream.shards(stream, token_stream.length(stream), SHARD).write.format("shards").mode("append").save(path)
    read = spark.read.format("shards").load(path)
    return read.select("part", "shard", F.expr("octet_length(data) div 2").cast("long").alias("n"), F.sha2("data", 256).alias("sha256"))


@query(f"""
WITH RECURSIVE c AS (SELECT doc_id, text, length(text)::BIGINT AS len, row_number() OVER (ORDER BY doc_id) AS place FROM documents WHERE text IS NOT NULL),
p AS (
  SELECT place, len AS used, 0::BIGINT AS win, 0::BIGINT AS boundary FROM c WHERE place = 1
  UNION ALL
  SELECT place, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END + len, win + opens::INT, CASE WHEN opens THEN 0 ELSE used + behind::BIGINT END FROM (
    SELECT c.place, c.len, used, win, used + 1 + c.len <= {PACK} AS behind, used > 0 AND used + 1 + c.len > {PACK} AS opens FROM p JOIN c ON c.place = p.place + 1)
)
SELECT win, count(*) AS n, max(boundary + len) AS used, min(doc_id) AS first_doc, string_agg(boundary::VARCHAR, ',' ORDER BY place) AS boundaries, sha256(string_agg(text, chr(10) ORDER BY place)) AS text_sha256 FROM p JOIN c USING (place) GROUP BY win""")
def packed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the order of their ids, packed into windows of 4,096 characters."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", F.length("text").alias("len"))
    rows = packing.packed(docs, "doc_id", "len", PACK).groupBy("win").agg(F.sort_array(F.collect_list(F.struct("place", "boundary", "doc_id", "text", "len"))).alias("docs"))
    joined = lambda c, by: F.array_join(F.transform("docs", lambda d: d[c].cast("string")), by)
    used = F.array_max(F.transform("docs", lambda d: d["boundary"] + d["len"]))
    return rows.select("win", F.size("docs").cast("long").alias("n"), used.alias("used"), F.array_min(F.transform("docs", lambda d: d["doc_id"])).alias("first_doc"), joined("boundary", ",").alias("boundaries"), F.sha2(joined("text", "\n").cast("binary"), 256).alias("text_sha256"))
