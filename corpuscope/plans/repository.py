"""Queries over a repository's graph: orders are source files written from their keys, of changing shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import chunk_id, chunk_spans, node_id
from corpuscope.operators import graph, repository
from corpuscope.operators.cut import cut
from corpuscope.registry import query, table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("import src.m"), cust % 7, F.lit("\nfrom lib"), key % 5, F.lit(" import x\n"), F.when(cust % 2 == 0, F.concat(F.lit("@GetMapping('/orders/"), cust % 20, F.lit("')\n"))).otherwise(""),
        F.lit("def run_"), key % 13, F.lit("(a, b) -> int:\n    return a\n"), F.when(key % 4 == 0, F.concat(F.lit("class Order"), key % 9, F.lit("(Base):\n"))).otherwise(""),
        F.when(cust % 3 == 0, F.concat(F.lit("    def test_"), cust % 10, F.lit("(self):\n        sql('select 1 from orders join t"), key % 3, F.lit(" on 1 = 1')\n"))).otherwise("    def go(self):\n        pass\n"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("src/m"), cust % 7, F.lit("/f "), key, F.lit(".py")).alias("path"), text.alias("text"))


_FILES = r"""
f AS (SELECT 'src/m' || o_custkey % 7 || '/f ' || o_orderkey || '.py' AS path, 'import src.m' || o_custkey % 7 || chr(10) || 'from lib' || o_orderkey % 5 || ' import x' || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN '@GetMapping(''/orders/' || o_custkey % 20 || ''')' || chr(10) ELSE '' END
  || 'def run_' || o_orderkey % 13 || '(a, b) -> int:' || chr(10) || '    return a' || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN 'class Order' || o_orderkey % 9 || '(Base):' || chr(10) ELSE '' END
  || CASE WHEN o_custkey % 3 = 0 THEN '    def test_' || o_custkey % 10 || '(self):' || chr(10) || '        sql(''select 1 from orders join t' || o_orderkey % 3 || ' on 1 = 1'')' || chr(10) ELSE '    def go(self):' || chr(10) || '        pass' || chr(10) END AS text FROM orders),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM f),
s AS (SELECT path, n, CASE WHEN regexp_matches(line, '^\s*def ') THEN 'function' ELSE 'class' END AS kind, regexp_extract(line, '^\s*(?:def|class)\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l WHERE regexp_matches(line, '^\s*(def|class)\s+[A-Za-z_].*:$')),
i AS (SELECT path, regexp_extract(line, '^\s*(?:import|from)\s+([A-Za-z0-9_.]+)', 1) AS imp FROM l WHERE regexp_matches(line, '^\s*(import|from)\s')),
e AS (SELECT path, unnest(regexp_extract_all(text, '@GetMapping\(''([^'']+)''\)', 1)) AS ep FROM f),
t AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '(?i)\b(?:FROM|JOIN|INTO|UPDATE|TABLE|INSERT INTO)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS tab FROM f),
tests AS (SELECT DISTINCT path FROM s WHERE contains(lower(name), 'test') UNION SELECT path FROM f WHERE regexp_matches(lower(path), 'test|spec')),
ts AS (SELECT DISTINCT s.path, s.name FROM s JOIN tests USING (path) WHERE kind = 'function'),
edges AS (
  SELECT DISTINCT * FROM (SELECT 'shop' AS source, nid(path) AS target, 'CONTAINS' AS type FROM f UNION ALL SELECT nid(path), nid(path || ':' || name), 'CONTAINS' FROM s UNION ALL SELECT nid(path), nid(replace(imp, '.', '/')), 'IMPORTS' FROM i
  UNION ALL SELECT nid(path), nid(path || ':endpoint:' || ep), 'DEFINES_ENDPOINT' FROM e UNION ALL SELECT nid(path), nid('table:' || tab), 'READS_TABLE' FROM t
  UNION ALL SELECT nid(ts.path || ':test:' || ts.name), nid(s.path || ':' || s.name), 'TESTS' FROM ts JOIN s ON s.path = ts.path AND s.name <> ts.name)
), raw AS (
  SELECT 'shop' AS id, 'MODULE' AS type, 'shop' AS name, NULL AS file, NULL::INT AS line, 0 AS o UNION ALL SELECT nid(path), 'FILE', path, NULL, NULL, 1 FROM f UNION ALL SELECT nid(path || ':' || name), upper(kind), name, path, n::INT, 2 FROM s
  UNION ALL SELECT nid(path || ':endpoint:' || ep), 'ENDPOINT', ep, path, NULL, 3 FROM e UNION ALL SELECT nid('table:' || tab), 'DATABASE_TABLE_REFERENCE', tab, NULL, NULL, 4 FROM t UNION ALL SELECT nid(path || ':test:' || name), 'TEST', name, path, NULL, 5 FROM ts
), nodes AS (SELECT id, type, name, file, line FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY o, file NULLS FIRST, line NULLS FIRST) = 1)""".replace("nid(", "trim_id(")


def _expand(sql: str) -> str:
    """Every trim_id(x) as the clean-up of a node's name; x has balanced parentheses."""
    while (at := sql.find("trim_id(")) >= 0:
        depth, end = 1, at + len("trim_id(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}trim(regexp_replace({sql[at + len('trim_id('):end - 1]}, '[^A-Za-z0-9_./-]', '-', 'g'), '-'){sql[end:]}"
    return sql


#: The files and their graph as CTEs: f (files), l (lines), s (symbols), i (imports), e (endpoints), t (tables), tests, nodes and edges.
GRAPH = _expand(_FILES)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return repository.graph(cut(repository.parsed(files(spark, sf_dir), "python", "py").drop("text"), "parsed"), "shop")


@query(f"WITH {GRAPH} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the repository's graph, once for each id."""
    return _graph(spark, sf_dir)[0]


@query(f"WITH {GRAPH} SELECT * FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the repository's graph, once for each ends and type."""
    return _graph(spark, sf_dir)[1]


@query(f"WITH {GRAPH} SELECT 'node' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def type_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type of node and edge occurs."""
    nodes, edges = _graph(spark, sf_dir)
    count = lambda df, what: df.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@query(f"""
WITH {GRAPH} SELECT (SELECT count(*) FROM f) AS files, (SELECT sum(length(text))::BIGINT FROM f) AS chars, (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM f) AS chunks, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges""")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts; a file of less than 1500 characters is one chunk."""
    rows = cut(repository.parsed(files(spark, sf_dir), "python", "py"))
    nodes, edges = repository.graph(rows, "shop")
    sums = rows.agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("symbols")).alias("symbols"), F.sum(F.size(chunk_spans(F.col("text")))).alias("chunks"))
    return sums.crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


@query(f"""
WITH {GRAPH} SELECT id, name AS label, type, NULL AS source, NULL AS target FROM nodes UNION ALL SELECT NULL, NULL, type, source, target FROM edges""")
def graph_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges in one frame, as graph viewers want them."""
    nodes, edges = _graph(spark, sf_dir)
    return nodes.select("id", F.col("name").alias("label"), "type").unionByName(edges, allowMissingColumns=True)


@query(f"""
WITH {GRAPH}, near AS (SELECT source AS node, target AS other, type FROM edges WHERE type IN ('IMPORTS', 'CONTAINS', 'CALLS') UNION ALL SELECT target, source, type FROM edges WHERE type IN ('IMPORTS', 'CONTAINS', 'CALLS')),
h1 AS (SELECT DISTINCT other AS node FROM near WHERE node = 'src/m3'), h2 AS (SELECT DISTINCT other AS node FROM near WHERE node IN (SELECT node FROM h1) AND other <> 'src/m3' AND other NOT IN (SELECT node FROM h1))
SELECT 'src/m3' AS node UNION ALL SELECT node FROM h1 WHERE node <> 'src/m3' UNION ALL SELECT node FROM h2""")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps of a module over edges of three types."""
    seeds = spark.createDataFrame([("src/m3",)], "node string")
    return graph.expanded(cut(_graph(spark, sf_dir)[1]), seeds, 2, ["IMPORTS", "CONTAINS", "CALLS"])[0]


@query(f"""
WITH {GRAPH}, near AS (SELECT 'lib2' AS node UNION SELECT source FROM edges WHERE target = 'lib2' UNION SELECT target FROM edges WHERE source = 'lib2')
SELECT DISTINCT source, target, type FROM edges WHERE source IN (SELECT node FROM near) OR target IN (SELECT node FROM near)""")
def library_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an end within a step of a library."""
    return graph.subgraph(cut(_graph(spark, sf_dir)[1]), spark.createDataFrame([("lib2",)], "node string"), 1)


@query(f"""
WITH {GRAPH}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM nodes WHERE type IN ('MODULE', 'FILE', 'DATABASE_TABLE_REFERENCE')),
x AS (SELECT DISTINCT a.id AS i, b.id AS j FROM edges JOIN k a ON a.id = source JOIN k b ON b.id = target) SELECT i AS row_id, j AS column_id, 1.0::DOUBLE AS value FROM x""")
def adjacency_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the adjacency matrix of files and tables; numbers of a distributed order stand for the ids."""
    nodes, edges = _graph(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = nodes.where(F.col("type").isin("MODULE", "FILE", "DATABASE_TABLE_REFERENCE")).select("id").repartitionByRange(n, "id").sortWithinPartitions("id")
    ids = cut(ids.withColumn("number", F.monotonically_increasing_id()))  # rises with the id; gaps between partitions
    cells = repository.adjacency(ids, edges)
    name = lambda column: ids.select(F.col("number").alias(column), F.col("id").alias(f"{column}_id"))
    return cells.join(name("row"), "row").join(name("column"), "column").select("row_id", "column_id", "value")


@query(f"""
WITH {GRAPH}, b AS (SELECT source AS node, target AS other FROM edges WHERE type IN ('IMPORTS', 'READS_TABLE') UNION ALL SELECT target, source FROM edges WHERE type IN ('IMPORTS', 'READS_TABLE'))
SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other)::INT AS place FROM (SELECT DISTINCT node, other FROM b) QUALIFY place <= 8""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight nodes that share an import or a table with each node, in the order of their names."""
    edges = _graph(spark, sf_dir)[1].where("type in ('IMPORTS', 'READS_TABLE')")
    return repository.co_occurring(edges.withColumn("order", F.lit(0)))


@query(f"""
WITH {GRAPH}, imps AS (SELECT DISTINCT 'src.' || name || CASE WHEN n % 2 = 0 THEN '_extra' ELSE '' END AS imp FROM s WHERE kind = 'class'), named AS (SELECT id, name FROM nodes WHERE type IN ('CLASS', 'FUNCTION'))
SELECT imp AS import, id FROM imps JOIN named ON contains(imp, name)""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that imports may mean; imports are made of class names, some with more behind."""
    rows = cut(repository.parsed(files(spark, sf_dir), "python", "py"))
    nodes, _ = repository.graph(rows, "shop")
    classes = rows.select(F.explode("symbols").alias("s")).where("s.kind = 'class'")
    imports = classes.select(F.concat(F.lit("src."), "s.name", F.when(F.col("s.line") % 2 == 0, "_extra").otherwise("")).alias("import"))
    return repository.import_candidates(imports, nodes)


@query(f"""
WITH {GRAPH}, chain AS (SELECT source, target FROM edges WHERE type = 'IMPORTS' UNION ALL SELECT 'app/' || regexp_extract(target, '[0-9]+$'), source FROM edges WHERE type = 'IMPORTS' AND starts_with(target, 'lib')),
d1 AS (SELECT DISTINCT source AS node FROM chain WHERE target = 'lib1') SELECT node FROM d1 UNION SELECT source FROM chain WHERE target IN (SELECT node FROM d1)""")
def transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports a library, directly or by one step more; applications that import the files are added."""
    edges = _graph(spark, sf_dir)[1].where("type = 'IMPORTS'")
    apps = edges.where(F.col("target").startswith("lib")).select(F.concat(F.lit("app/"), F.regexp_extract("target", "[0-9]+$", 0)).alias("source"), F.col("source").alias("target"), "type")
    return graph.dependents(cut(edges.unionByName(apps)), spark.createDataFrame([("lib1",)], "node string"), 2)


@query(f"""
WITH {GRAPH}, step AS (SELECT target AS node, source AS other FROM edges UNION SELECT source, target FROM edges WHERE type IN ('TESTS', 'CALLS', 'IMPORTS')), own AS (SELECT id, trim(regexp_replace(file, '[^A-Za-z0-9_./-]', '-', 'g'), '-') AS file FROM nodes WHERE file IS NOT NULL),
c1 AS (SELECT DISTINCT other AS node FROM step WHERE node = 'table-t1' AND other <> 'table-t1'), f1 AS (SELECT DISTINCT coalesce(file, node) AS node FROM c1 LEFT JOIN own ON id = node),
c2 AS (SELECT DISTINCT other AS node FROM step JOIN f1 USING (node) WHERE other <> 'table-t1' AND other NOT IN (SELECT node FROM c1)) SELECT 'table-t1' AS node UNION ALL SELECT node FROM c1 UNION ALL SELECT node FROM c2""")
def effect_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of a table may touch, in two rounds."""
    rows = cut(repository.parsed(files(spark, sf_dir), "python", "py").drop("text"), "parsed")
    own = repository.nodes_of(rows, "shop").where("file is not null").select(F.col("id").alias("node"), node_id(F.col("file")).alias("file"))
    edges = cut(repository.links_of(rows, "shop"), "links")
    return graph.effect_cone(edges, own, spark.createDataFrame([("table-t1",)], "node string"), 2, repository.without_file(rows, "shop"))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS chunk, (l_linenumber - 1) * 10 + 1 AS a, l_linenumber * 10 AS b FROM lineitem),
s AS (SELECT l_orderkey AS file, (l_partkey % 70 + 1)::INT AS line, arg_max('s' || l_suppkey, (l_linenumber, l_suppkey)) AS name FROM lineitem GROUP BY ALL)
SELECT c.file, chunk, a AS first_line, b AS last_line, arg_min(name, line) AS symbol FROM c LEFT JOIN s ON s.file = c.file AND line BETWEEN a AND b GROUP BY ALL""")
def symbol_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of an order are chunks of ten lines, parts say on which line a symbol is."""
    lines = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber")
    chunks = lines.select(F.col("l_orderkey").alias("file"), number.alias("chunk"), ((number - 1) * 10 + 1).alias("first_line"), (number * 10).alias("last_line")).distinct()
    symbols = lines.select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 70 + 1).cast("int").alias("line"), F.struct("l_linenumber", "l_suppkey").alias("order"), F.concat(F.lit("s"), "l_suppkey").alias("name"))
    return repository.symbol_chunks(chunks, symbols)


@query("""
WITH b AS (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 1499) // 1500))) AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k * 1500 AS s, substr(text, k * 1500 + 1, 1500) AS t FROM b)
SELECT doc_id, s AS start, substr(sha256('d' || doc_id || '.txt:' || s || ':' || t), 1, 16) AS chunk_id, sha256(t) AS hash FROM c""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and hashes of chunks of 1500 characters."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    # Cut once, so that no chunk counts code points from the start of its text.
    parts = F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,1500}"), F.lit(0)))
    rows = docs.select("doc_id", F.posexplode(parts).alias("k", "t")).select("doc_id", (F.col("k").cast("long") * 1500).alias("start"), "t")
    return rows.select("doc_id", "start", chunk_id(F.concat(F.lit("d"), "doc_id", F.lit(".txt")), F.col("start"), F.col("t")).alias("chunk_id"), F.sha2(F.col("t").cast("binary"), 256).alias("hash"))
