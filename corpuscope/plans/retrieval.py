"""Queries over retrieval: benchmark items are the questions, documents the chunks, orders and suppliers a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.functions import text
from corpuscope.operators import dense, graph, order, ranking
from corpuscope.operators.cut import cut
from corpuscope.registry import query, table

_TERMS = """
post AS (
  SELECT doc_id AS doc, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents) WHERE length(t) > 1 GROUP BY ALL
), lens AS (
  SELECT doc, sum(tf)::BIGINT AS length FROM post GROUP BY doc
), totals AS (
  SELECT (SELECT count(*) FROM documents) AS n, sum(length)::DOUBLE / (SELECT count(*) FROM documents) AS mean_length FROM lens
), asked AS (
  SELECT item_id AS query, t AS term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM benchmark) WHERE length(t) > 1 GROUP BY ALL
), dfs AS (
  SELECT term, count(*) AS df FROM post GROUP BY term
), scores AS (
  SELECT query, post.doc, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score
  FROM post JOIN asked USING (term) JOIN dfs USING (term) JOIN lens ON lens.doc = post.doc, totals GROUP BY ALL
), bm AS (
  SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc DESC) AS rank FROM scores QUALIFY rank <= 30
), seen AS (
  SELECT query, doc, count(*) AS score FROM post JOIN asked USING (term) GROUP BY ALL
), ov AS (
  SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM seen QUALIFY rank <= 30
)"""


_DENSE = f"""
WITH RECURSIVE {_TERMS}, dv AS (
  SELECT doc, idx, CASE WHEN idx % 2 = 1 THEN n ELSE -n END / sqrt(sum(n * n) OVER (PARTITION BY doc)) AS v FROM (SELECT doc, ('0x' || substr(md5(term), 1, 2))::INT AS idx, sum(tf)::DOUBLE AS n FROM post GROUP BY ALL)
), qv AS (
  SELECT query, idx, CASE WHEN idx % 2 = 1 THEN n ELSE -n END / sqrt(sum(n * n) OVER (PARTITION BY query)) AS v FROM (SELECT query, ('0x' || substr(md5(term), 1, 2))::INT AS idx, sum(times)::DOUBLE AS n FROM asked GROUP BY ALL)
), dots AS (
  SELECT query, doc, sum(dv.v * qv.v) AS dot FROM qv JOIN dv USING (idx) GROUP BY ALL
), de AS (
  SELECT item_id AS query, doc_id AS doc, round(coalesce(dot, 0), 6) + 0.0 AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(coalesce(dot, 0), 6) DESC, doc_id) AS rank
  FROM benchmark CROSS JOIN documents LEFT JOIN dots ON query = item_id AND doc = doc_id QUALIFY rank <= 30
), two AS (
  SELECT 0 AS list, query, doc, rank, score FROM bm UNION ALL SELECT 1, query, doc, rank, score FROM de
), fu AS (
  SELECT query, doc, score, best_rank, row_number() OVER (PARTITION BY query ORDER BY score DESC, first) AS rank FROM (
    SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(rank) AS best_rank, min(list * 1000 + rank) AS first FROM two GROUP BY ALL)
)"""
_PATH = "'d' || doc || (['.py', '.md', '_test.go', '.ts'])[(doc % 4 + 1)::INT]"
_CONTEXT = f"""{_DENSE}, own AS (
  SELECT query, fu.doc, count(term) AS shared FROM fu JOIN asked USING (query) LEFT JOIN post USING (doc, term) WHERE post.doc IS NOT NULL GROUP BY ALL
), rr AS (
  SELECT query, doc, s AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, r) AS rank FROM (
    SELECT fu.query, fu.doc, fu.rank AS r, round(coalesce(shared, 0) + CASE WHEN fu.doc % 5 = 0 THEN 0.3 ELSE 0 END + CASE WHEN fu.doc % 4 IN (0, 2, 3) THEN 0.1 ELSE 0 END + CASE WHEN fu.doc % 4 = 2 THEN 0.05 ELSE 0 END, 6)::DOUBLE AS s FROM fu LEFT JOIN own ON own.query = fu.query AND own.doc = fu.doc) QUALIFY rank <= 30
), links AS (
  SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + 1, doc_id FROM documents WHERE doc_id % 3 = 0
), ad AS (
  SELECT query, b AS doc, 1000 + row_number() OVER (PARTITION BY query ORDER BY min(rank), b) AS place FROM rr JOIN links ON a = doc
  WHERE NOT EXISTS (SELECT 1 FROM rr x WHERE x.query = rr.query AND x.doc = b) AND b IN (SELECT doc_id FROM documents) GROUP BY query, b
), ex AS (
  SELECT query, doc, rank AS place, 'reranked' AS reason FROM rr UNION ALL SELECT query, doc, place, 'graph-expansion' FROM ad
), dd AS (
  SELECT query, doc, reason, text, row_number() OVER (PARTITION BY query ORDER BY place) AS n FROM (
    SELECT ex.*, text, row_number() OVER (PARTITION BY query, sha256(coalesce(text, '')) ORDER BY place) AS copy FROM ex JOIN documents ON doc_id = doc) WHERE copy = 1
), sized AS (
  SELECT dd.query, dd.doc, dd.reason, n, greatest(1, round_even(length(coalesce(dd.text, '')) / 4.0, 0)::BIGINT) AS tokens, 8192 - greatest(1, round_even(length(coalesce(benchmark.text, '')) / 4.0, 0)::BIGINT) AS budget FROM dd JOIN benchmark ON item_id = query
), pk AS (
  SELECT *, tokens <= budget AS included, CASE WHEN tokens <= budget THEN tokens ELSE 0 END AS used FROM sized WHERE n = 1
  UNION ALL SELECT s.*, pk.used + s.tokens <= s.budget, pk.used + CASE WHEN pk.used + s.tokens <= s.budget THEN s.tokens ELSE 0 END FROM pk JOIN sized s ON s.query = pk.query AND s.n = pk.n + 1
)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query"), F.explode(text.retrieval_tokens(F.col("text"))).alias("term"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with those of their terms that some question asks for."""
    return ranking.matched(table(spark, sf_dir, "documents"), "doc_id", "text", _questions(spark, sf_dir))


def _bm25(spark: SparkSession, sf_dir: str, match: DataFrame | None = None) -> DataFrame:
    match = _matched(spark, sf_dir) if match is None else match
    totals = match.agg(F.sum("copies").alias("n"), F.try_divide(F.sum("length"), F.sum("copies")).alias("mean_length"))
    return ranking.bm25_top(match, totals, _questions(spark, sf_dir), 30, digits=6)


def _overlap(spark: SparkSession, sf_dir: str, match: DataFrame | None = None) -> DataFrame:
    return ranking.overlap_top(_matched(spark, sf_dir) if match is None else match, _questions(spark, sf_dir), 30)


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = dense.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "doc")
    queries = dense.hashed_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query")
    return dense.dense_top(vectors, queries, 30)


def _fused(lists: list[DataFrame]) -> DataFrame:
    """query, doc, score, best_rank and rank of the fused list; ties go to the earlier list, then its order."""
    rows = ranking.fused(lists).withColumn("score", F.round("score", 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first")))  # at most the lists' rows for each question


@query(f"WITH {_TERMS} SELECT query, doc, score, rank FROM bm")
def bm25_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 best documents of each question; pairs of questions and documents stay in their task, but for each task's best."""
    return _bm25(spark, sf_dir).select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_TERMS} SELECT query, doc, score, rank FROM ov")
def overlap_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: ranking by distinct terms that question and document share."""
    return _overlap(spark, sf_dir).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_DENSE} SELECT query, doc, score, rank FROM de")
def dense_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 documents with the largest inner product of hashed vectors; every document is compared."""
    return _dense(spark, sf_dir).select("query", "doc", (F.col("score") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {_TERMS}, both_lists AS (SELECT query, doc, rank FROM bm UNION ALL SELECT query, doc, rank FROM ov)
SELECT query, doc, sum(1.0::DOUBLE / (60 + rank)) AS score, min(rank) AS best_rank FROM both_lists GROUP BY ALL""")
def fused_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of the two lists, which share one pass over the texts."""
    match = _matched(spark, sf_dir)
    return ranking.fused([_bm25(spark, sf_dir, match), _overlap(spark, sf_dir, match)]).select("query", "doc", "score", F.col("best_rank").cast("long").alias("best_rank"))


@query(f"""
{_DENSE}, every AS (SELECT query, 'BM25' AS stage, doc, rank, score FROM bm UNION ALL SELECT query, 'dense', doc, rank, score FROM de UNION ALL SELECT query, 'RRF', doc, rank, score FROM fu)
SELECT query, stage, doc, rank, floor(score * 10000 + 0.5) / 10000 AS score FROM every""")
def fusion_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each list and of their fusion, one row for each stage and candidate."""
    lists = {"BM25": cut(_bm25(spark, sf_dir)), "dense": cut(_dense(spark, sf_dir))}
    lists["RRF"] = _fused(list(lists.values()))
    row = lambda stage, df, digits: df.select("query", F.lit(stage).alias("stage"), "doc", F.col("rank").cast("long").alias("rank"), (F.floor(F.round("score", digits) * 10000 + 0.5) / 10000).alias("score"))
    stages = [row(stage, df, 9 if stage == "RRF" else 6) for stage, df in lists.items()]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


def _reranked(spark: SparkSession, sf_dir: str, fused: DataFrame) -> DataFrame:
    """The 30 best of the fused list by shared terms and bonuses; every fifth document has a symbol, paths go by id."""
    chosen = fused.select("query", "doc", F.col("rank").alias("before"))
    docs = table(spark, sf_dir, "documents").join(chosen.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi")
    terms = docs.select(F.col("doc_id").alias("doc"), F.array_distinct(F.coalesce(text.retrieval_tokens(F.col("text")), F.array().cast("array<string>"))).alias("terms"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(F.coalesce(text.retrieval_tokens(F.col("text")), F.array().cast("array<string>"))).alias("asked"))
    doc = F.col("doc")
    path = F.concat(F.lit("d"), doc, F.element_at(F.array(*map(F.lit, [".py", ".md", "_test.go", ".ts"])), (doc % 4 + 1).cast("int")))
    score = F.round(ranking.rerank_score(F.col("asked"), F.col("terms"), F.when(doc % 5 == 0, "f"), path), 6)
    rows = chosen.join(terms, "doc").join(asked, "query").select("query", "doc", "before", score.alias("score"))
    return ranking.top(rows, "query", [F.desc("score"), F.asc("before")], 30)


@query(f"{_CONTEXT} SELECT query, doc, score, rank FROM rr")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the fused list in the order of shared terms and bonuses, ties as they were."""
    fused = cut(_fused([_bm25(spark, sf_dir), _dense(spark, sf_dir)]))
    return _reranked(spark, sf_dir, fused).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


def _context(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Stages of retrieval with their candidates (query, doc), and the packed chunks: query, n, doc, reason, tokens and included."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bm, de = cut(_bm25(spark, sf_dir)), cut(_dense(spark, sf_dir))
    fused = cut(_fused([bm, de]))
    best = cut(_reranked(spark, sf_dir, fused))
    known = best.join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi")  # chunks that aren't in the index go
    links = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    links = links.union(links.select("b", "a"))
    near = known.join(links, F.col("doc") == F.col("a")).groupBy("query", F.col("b").alias("doc")).agg(F.min("rank").alias("seed")).join(known.select("query", "doc"), ["query", "doc"], "left_anti")
    near = near.join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi")
    added = near.select("query", "doc", (F.lit(1000) + F.row_number().over(Window.partitionBy("query").orderBy("seed", "doc"))).alias("place"), F.lit("graph-expansion").alias("reason"))
    wide = cut(known.select("query", "doc", F.col("rank").alias("place"), F.lit("reranked").alias("reason")).unionByName(added))
    texts = docs.join(wide.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi")
    texts = texts.select(F.col("doc_id").alias("doc"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"), text.approx_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    once = cut(ranking.first_texts(wide.join(texts, "doc"), "query", "place", "hash"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.lit(8192) - text.approx_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("budget"))
    # At most 30 chunks and their neighbours for each question.
    packs = once.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "doc", "reason", "tokens"))).alias("c")).join(asked, "query")
    packs = packs.withColumn("taken", ranking.packed(F.transform("c", lambda c: c["tokens"]), F.col("budget"))["taken"])
    each = packs.select("query", F.posexplode(F.arrays_zip("c", "taken")).alias("n", "x")).select("query", (F.col("n") + 1).cast("long").alias("n"), "x.c.doc", "x.c.reason", "x.c.tokens", F.col("x.taken").alias("included"))
    return {"BM25": bm, "dense": de, "RRF": fused, "rerank": best, "AST normalization": known, "graph expansion": wide, "deduplication": once}, each


@query(f"{_CONTEXT} SELECT query, n, doc, reason, tokens, included FROM pk")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for each question, reranked, widened by imports, without copies, and which of them fit."""
    return _context(spark, sf_dir)[1]


@query(f"""
{_CONTEXT} SELECT query, 'BM25' AS stage, count(*) AS candidates, NULL::BIGINT AS used_tokens, NULL::BIGINT AS packed_tokens FROM bm GROUP BY query
UNION ALL SELECT query, 'dense', count(*), NULL, NULL FROM de GROUP BY query UNION ALL SELECT query, 'RRF', count(*), NULL, NULL FROM fu GROUP BY query UNION ALL SELECT query, 'rerank', count(*), NULL, NULL FROM rr GROUP BY query
UNION ALL SELECT query, 'AST normalization', count(*), NULL, NULL FROM rr GROUP BY query UNION ALL SELECT query, 'graph expansion', count(*), NULL, NULL FROM ex GROUP BY query UNION ALL SELECT query, 'deduplication', count(*), NULL, NULL FROM dd GROUP BY query
UNION ALL SELECT query, 'context compression', count(*), coalesce(sum(tokens) FILTER (included), 0)::BIGINT, sum(tokens)::BIGINT FROM pk GROUP BY query""")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: candidates of all eight stages; tokens that were used, and those of all packed chunks, excluded ones too."""
    stages, packed = _context(spark, sf_dir)
    count = lambda stage, df: df.groupBy("query").agg(F.count("*").alias("candidates")).select("query", F.lit(stage).alias("stage"), "candidates", F.lit(None).cast("long").alias("used_tokens"), F.lit(None).cast("long").alias("packed_tokens"))
    rows = packed.groupBy("query").agg(F.count("*").alias("candidates"), F.coalesce(F.sum(F.when(F.col("included"), F.col("tokens"))), F.lit(0)).alias("used_tokens"), F.sum("tokens").alias("packed_tokens"))
    out = rows.select("query", F.lit("context compression").alias("stage"), "candidates", "used_tokens", "packed_tokens")
    for stage, df in stages.items():
        out = out.unionByName(count(stage, df))
    return out


@query(f"""
{_DENSE}, gold AS (SELECT item_id AS query, doc_id AS doc FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40),
s AS (SELECT gold.query, count(*) AS gold, count(rank) FILTER (rank <= 10) AS hits, min(rank) AS first_hit FROM gold LEFT JOIN bm ON bm.query = gold.query AND bm.doc = gold.doc GROUP BY gold.query)
SELECT query, gold, hits / gold::DOUBLE AS recall_at_10, first_hit FROM s""")
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and rank of the first hit of lexical retrieval against gold documents dealt by id."""
    gold = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), (F.col("doc_id") % 40).alias("k"))
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 40).alias("k")).join(gold, "k").select("query", "doc")
    ranked = _bm25(spark, sf_dir).select("query", "doc", "rank")
    rows = gold.join(ranked, ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("gold"), F.count_if(F.col("rank") <= 10).alias("hits"), F.min("rank").cast("long").alias("first_hit"))
    return rows.select("query", "gold", (F.col("hits") / F.col("gold")).alias("recall_at_10"), "first_hit")


@query("""
WITH f AS (SELECT l_orderkey AS file, l_linenumber * 10 AS line, l_partkey % 4 AS category, l_suppkey % 3 AS severity FROM lineitem WHERE l_returnflag <> 'A'),
g AS (SELECT l_orderkey AS file, l_linenumber * 10 + l_partkey % 3 AS line, l_partkey % 4 AS category, l_suppkey % 2 AS severity FROM lineitem WHERE l_returnflag <> 'N'),
m AS (SELECT f.file, count(*) AS tp, count(*) FILTER (f.severity = g.severity) AS right_severity FROM f JOIN g ON f.file = g.file AND f.category = g.category AND abs(f.line - g.line) <= 2 GROUP BY ALL),
n AS (SELECT file, sum(found)::BIGINT AS found, sum(gold)::BIGINT AS gold FROM (SELECT file, 1 AS found, 0 AS gold FROM f UNION ALL SELECT file, 0, 1 FROM g) GROUP BY file)
SELECT sum(found)::BIGINT AS found, sum(gold)::BIGINT AS gold, sum(tp)::BIGINT AS matched, sum(tp)::DOUBLE / sum(found) AS precision, sum(tp)::DOUBLE / sum(gold) AS recall, 2 * sum(tp)::DOUBLE / (sum(found) + sum(gold)) AS f1, sum(right_severity)::DOUBLE / sum(tp) AS severity_accuracy FROM n LEFT JOIN m USING (file)""")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and severity accuracy of findings against gold ones of their file, within two lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    f = lines.where("l_returnflag <> 'A'").select("file", (F.col("l_linenumber") * 10).alias("line"), (F.col("l_partkey") % 4).alias("category"), (F.col("l_suppkey") % 3).alias("severity"))
    g = lines.where("l_returnflag <> 'N'").select("file", (F.col("l_linenumber") * 10 + F.col("l_partkey") % 3).alias("gold_line"), (F.col("l_partkey") % 4).alias("category"), (F.col("l_suppkey") % 2).alias("gold_severity"))
    met = f.join(g, ["file", "category"]).where(F.abs(F.col("line") - F.col("gold_line")) <= 2).agg(F.count("*").alias("matched"), F.count_if(F.col("severity") == F.col("gold_severity")).alias("right"))
    sums = f.agg(F.count("*").alias("found")).crossJoin(g.agg(F.count("*").alias("gold"))).crossJoin(met)  # one row each
    return sums.select("found", "gold", "matched", (F.col("matched") / F.col("found")).alias("precision"), (F.col("matched") / F.col("gold")).alias("recall"), (2 * F.col("matched") / (F.col("found") + F.col("gold"))).alias("f1"), (F.col("right") / F.col("matched")).alias("severity_accuracy"))


@query("""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, greatest(1, round_even(length(text) / 4.0, 0)::BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations WHERE text IS NOT NULL
), p AS (
  SELECT conv_id, place, turn, tokens, tokens <= 256 AS included, CASE WHEN tokens <= 256 THEN tokens ELSE 0 END AS used FROM c WHERE place = 1
  UNION ALL
  SELECT c.conv_id, c.place, c.turn, c.tokens, used + c.tokens <= 256, used + CASE WHEN used + c.tokens <= 256 THEN c.tokens ELSE 0 END FROM p JOIN c ON c.conv_id = p.conv_id AND c.place = p.place + 1
)
SELECT conv_id, place, turn, tokens, included FROM p""")
def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: turns of a conversation that fit 256 tokens, in order; one that doesn't fit is skipped and later ones may fit."""
    rows = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    steps = F.sort_array(F.collect_list(F.struct("turn", "text_key", "tokens"))).alias("steps")
    sized = rows.select("conv_id", "turn", F.col("text").alias("text_key"), text.approx_tokens(F.col("text")).cast("long").alias("tokens"))
    packs = sized.groupBy("conv_id").agg(steps).withColumn("taken", ranking.packed(F.transform("steps", lambda s: s["tokens"]), F.lit(256))["taken"])
    each = packs.select("conv_id", F.posexplode(F.arrays_zip("steps", "taken")).alias("place", "step"))
    return each.select("conv_id", (F.col("place") + 1).cast("long").alias("place"), "step.steps.turn", "step.steps.tokens", F.col("step.taken").alias("included"))


@query("""
WITH p AS (SELECT least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS p, quality AS a FROM labels JOIN documents USING (doc_id)),
s AS (SELECT row_number() OVER (ORDER BY p DESC, a DESC) AS place, avg(a::DOUBLE) OVER (ORDER BY p DESC, a DESC ROWS UNBOUNDED PRECEDING) AS accuracy, count(*) OVER () AS n FROM p)
SELECT place, place::DOUBLE / n AS coverage, accuracy FROM s WHERE place % greatest(1, n // 20) = 0""")
def selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the surest share of answers, at every twentieth.

    Equal pairs are counted before they are ordered, and sums run side by side in ranges of the order.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    pairs = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("a"))
    groups = pairs.groupBy("p", "a").agg(F.count("*").alias("size"))
    by = [F.desc("p"), F.desc("a")]
    ends = order.running_total(order.running_total(groups, by, F.col("size"), "last"), by, F.col("a") * F.col("size"), "right")
    ends = ends.select("a", "size", (F.col("last") + F.col("size")).alias("last"), (F.col("right") + F.col("a") * F.col("size")).alias("right"))
    total = groups.agg(F.sum("size").alias("n"))
    marks = ends.crossJoin(F.broadcast(total)).withColumn("step", F.greatest(F.lit(1), F.expr("n div 20")))  # total is one row
    first = F.expr("((last - size) div step + 1) * step")
    places = marks.where(first <= F.col("last")).withColumn("place", F.explode(F.sequence(first.cast("long"), F.col("last"), F.col("step").cast("long"))))
    return places.select("place", (F.col("place") / F.col("n")).alias("coverage"), ((F.col("right") - F.col("a") * (F.col("last") - F.col("place"))) / F.col("place")).alias("accuracy"))


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier of each line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select("o_custkey", "l_suppkey")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers they were served by, of all lines; keys are told apart before they get their letters."""
    served = _served(spark, sf_dir).distinct()
    return served.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))


_EDGES = """
edges AS (SELECT DISTINCT 'c' || o_custkey AS source, 's' || l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
links AS (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges)"""


def _hops(steps: int) -> str:
    """Levels of a breadth-first search from s1, each without what was found before."""
    out = "h0 AS (SELECT 's1' AS node, 0 AS steps)"
    for k in range(1, steps + 1):
        out += f", h{k} AS (SELECT node, steps FROM h{k - 1} UNION ALL SELECT DISTINCT target, {k} FROM h{k - 1} JOIN links ON source = node WHERE steps = {k - 1} AND target NOT IN (SELECT node FROM h{k - 1}))"
    return out


@query(f"WITH {_EDGES}, {_hops(3)} SELECT node, steps FROM h3")
def dependency_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within three steps of the first supplier, along links of both directions."""
    return graph.reachable(_both(_edges(spark, sf_dir)), spark.createDataFrame([("s1",)], "node string"), 3)


@query(f"WITH {_EDGES}, {_hops(8)} SELECT steps, count(*) AS n, min(node) AS first FROM h8 GROUP BY steps")
def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: lengths of the shortest paths from the first supplier to every node that it reaches."""
    found = graph.distances(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"))
    return found.groupBy("steps").agg(F.count("*").alias("n"), F.min("node").alias("first"))


@query(f"WITH {_EDGES} SELECT source AS node, count(*) AS degree FROM links GROUP BY source")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each node; both directions come from one pass over the edges."""
    ends = _edges(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def _ranks(rounds: int) -> str:
    """Rounds of ranks, what each changed, and the first that changed less than a millionth for each node (the last, if none did)."""
    out = "nodes AS (SELECT source AS node, count(*) AS degree FROM links GROUP BY 1), r0 AS (SELECT node, degree, 1.0::DOUBLE / count(*) OVER () AS rank, count(*) OVER () AS n FROM nodes)"
    for k in range(1, rounds + 1):
        out += f", r{k} AS MATERIALIZED (SELECT r.node, r.degree, 0.15::DOUBLE / r.n + 0.85::DOUBLE * s.got AS rank, r.n FROM r{k - 1} r JOIN (SELECT target, sum(rank / degree) AS got FROM r{k - 1} JOIN links ON source = node GROUP BY target) s ON s.target = r.node)"
    changes = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) < any_value(a.n) * 1e-6 AS ends FROM r{k} AS a JOIN r{k - 1} AS b USING (node)" for k in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, node, rank FROM r{k}" for k in range(1, rounds + 1))
    return f"{out}, final AS (SELECT coalesce(min(k) FILTER (ends), {rounds}) AS k FROM ({changes})), ranks AS (SELECT node, rank FROM ({every}) JOIN final USING (k))"


@query(f"WITH {_EDGES}, {_ranks(70)} SELECT node, round(rank, 12) AS rank FROM ranks")
def page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over the links of both directions, of all lines, until they change by less than a millionth for each node."""
    return graph.pagerank(_both(_edges(spark, sf_dir))).select("node", F.round("rank", 12).alias("rank"))


@query()  # Brandes' algorithm needs counted paths; a test compares with a loop over a small graph
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness over the shortest paths from eight fixed suppliers."""
    customer, supplier = (lambda k: F.col(k).cast("long") * 2), (lambda k: F.col(k).cast("long") * 2 + 1)  # numbers instead of names
    links = _served(spark, sf_dir).select(customer("o_custkey").alias("source"), supplier("l_suppkey").alias("target"))
    found = graph.betweenness(links, table(spark, sf_dir, "supplier").where("s_suppkey <= 8").select(supplier("s_suppkey").alias("node")))
    name = F.concat(F.when(F.col("node") % 2 == 0, "c").otherwise("s"), F.shiftright("node", 1))
    return found.select(name.alias("node"), "betweenness")
