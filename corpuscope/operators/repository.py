"""A graph of source files: their symbols, imports, endpoints, tables and tests as nodes and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import code
from corpuscope.functions.text import id_characters, node_id
from corpuscope.operators.cut import cut


def parsed(files: DataFrame, language: str, extension: str) -> DataFrame:
    """path, text and what the text holds: symbols, imports, endpoints, tables and is_test."""
    text = F.col("text")
    rows = files.select("path", "text", code.symbols(text, language).alias("symbols"), code.imports(text, extension).alias("imports"), code.endpoints(text).alias("endpoints"), code.table_references(text).alias("tables"))
    return rows.withColumn("is_test", code.is_test(F.col("path"), F.transform("symbols", lambda s: s["name"])))


def _of(path: Column, what: Column | str, prefix: str = "") -> Column:
    return node_id(F.concat(path, F.lit(":" + prefix), what))


def graph(files: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, file, line) and edges (source, target, type) of parsed files, each once.

    Every kind of node is read from the parsed files, and edges twice, so these should be a stored table.
    """
    return nodes_of(files, repository), links_of(files, repository).distinct()


def _symbols(files: DataFrame) -> DataFrame:
    return files.select("path", "is_test", F.explode("symbols").alias("s")).select("path", "is_test", "s.*")


def nodes_of(files: DataFrame, repository: str) -> DataFrame:
    """Nodes of parsed files. Nodes with equal ids are one: of those the module and files come first, then symbols, endpoints,
    tables and tests, then the smaller path and line."""
    path, none = F.col("path"), F.lit(None)
    root = F.lit(repository)
    symbols = _symbols(files)
    endpoints = files.select("path", F.explode("endpoints").alias("name"))
    tables = files.select("path", F.explode("tables").alias("name"))
    tests = symbols.where("is_test and kind in ('function', 'method')").select("path", "name", "line").distinct()

    def nodes(df: DataFrame, order: int, id_: Column, type_: Column, name: Column, file: Column, line: Column) -> DataFrame:
        return df.select(id_.alias("id"), F.struct(F.lit(order).alias("order"), file.cast("string").alias("file"), line.cast("int").alias("line"), type_.alias("type"), name.alias("name")).alias("n"))

    every = (
        nodes(files.sparkSession.range(1), 0, node_id(root), F.lit("MODULE"), root, none, none)
        .unionByName(nodes(files, 1, node_id(path), F.lit("FILE"), path, none, none))
        .unionByName(nodes(symbols, 2, _of(path, F.col("name")), F.upper("kind"), F.col("name"), path, F.col("line")))
        .unionByName(nodes(endpoints, 3, _of(path, F.col("name"), "endpoint:"), F.lit("ENDPOINT"), F.col("name"), path, none))
        .unionByName(nodes(tables, 4, node_id(F.concat(F.lit("table:"), "name")), F.lit("DATABASE_TABLE_REFERENCE"), F.col("name"), none, none))
        .unionByName(nodes(tests, 5, _of(path, F.col("name"), "test:"), F.lit("TEST"), F.col("name"), path, none))
    )
    return every.groupBy("id").agg(F.min("n").alias("n")).select("id", "n.type", "n.name", "n.file", "n.line")


def without_file(files: DataFrame, repository: str) -> DataFrame:
    """node: ids of the module and of files, whose nodes come first and have no file."""
    return files.select(node_id(F.col("path")).alias("node")).union(files.sparkSession.range(1).select(node_id(F.lit(repository))))


def links_of(files: DataFrame, repository: str) -> DataFrame:
    """Edges of parsed files, some of them several times. A test's function is linked with the other symbols of its own file:
    names of other files would give nodes that don't exist, as many as files times names."""
    path, module = F.col("path"), node_id(F.lit(repository))

    def edge(source: Column, target: Column, type_: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(type_).alias("type"))

    def each(column: str, target: Callable[..., Column], type_: str) -> Column:
        return F.coalesce(F.transform(F.col(column), lambda x: edge(F.col("file"), target(x), type_)), F.array().cast("array<struct<source:string,target:string,type:string>>"))

    # A file's edges but those of tests are made in one pass over it; tests meet the other symbols of their row there, one test at a time.
    # Outer generators: for the others Spark adds a filter on their size, which would make the arrays three times.
    # Paths and names are looked through once each, and ids joined of them.
    strip = lambda *parts: F.btrim(F.concat(*parts), F.lit("-"))
    names = F.array_distinct(F.transform("symbols", lambda s: s["name"]))
    rows = files.select("path", "is_test", "symbols", "imports", "endpoints", "tables", names.alias("names"), id_characters(path).alias("base")).withColumns({"file": strip("base"), "base": F.concat("base", F.lit("-"))})
    part = lambda name, prefix="": strip(F.col("base"), F.lit(prefix), id_characters(name))
    own = rows.select(F.inline_outer(F.concat(
        F.array(edge(module, F.col("file"), "CONTAINS")), each("names", part, "CONTAINS"), each("imports", lambda i: node_id(F.replace(i, F.lit("."), F.lit("/"))), "IMPORTS"),
        each("endpoints", lambda e: part(e, "endpoint-"), "DEFINES_ENDPOINT"), each("tables", lambda t: node_id(F.concat(F.lit("table:"), t)), "READS_TABLE"))))
    said = F.array_distinct(F.transform(F.filter("symbols", lambda s: s["kind"].isin("function", "method")), lambda s: s["name"]))
    met = rows.where("is_test and path is not null").select("base", F.transform("names", lambda n: F.struct(n.alias("name"), part(n).alias("id"))).alias("targets"), F.explode_outer(said).alias("name")).where("name is not null")
    met = met.select("name", part(F.col("name"), "test-").alias("source"), F.explode_outer("targets").alias("t")).where("t.name <> name").select("source", F.col("t.id").alias("target"), F.lit("TESTS").alias("type"))
    links = own.unionByName(met)
    again = cut(files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1 and path is not null").select("path"))
    if not again.isEmpty():  # tests of a path in several rows also meet the symbols of its other rows
        here = _symbols(files).join(again, "path", "left_semi")
        others = here.where("is_test and kind in ('function', 'method')").select("path", "name").distinct().join(here.select("path", F.col("name").alias("target")).distinct(), "path").where("target <> name")
        links = links.unionByName(others.select(_of(path, F.col("name"), "test:").alias("source"), _of(path, F.col("target")).alias("target"), F.lit("TESTS").alias("type")))
    return links


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells (row, column, value 1.0) of the adjacency matrix; nodes has id and number, edges to unknown nodes are left out."""
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.col("number").alias(name))
    return edges.select("source", "target").distinct().join(at("source", "row"), "source").join(at("target", "column"), "target").select("row", "column", F.lit(1.0).alias("value"))


def co_occurring(edges: DataFrame, most: int = 8) -> DataFrame:
    """For each node its first neighbours by edge order (edges: source, target, order), no node twice, without parts of files."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "order").union(edges.select("target", "source", "order"))
    near = both.where(~F.contains("other", F.lit(":"))).groupBy("node", "other").agg(F.min("order").alias("order"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("order", "other"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("node", "other", "place")


def import_candidates(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols that an import may mean: those whose name it holds. imports: import; nodes: id, type, name.

    Parts of an import that could be a name are looked up by equality, so no import meets all symbols.
    """
    named = nodes.where(F.col("type").isin("CLASS", "INTERFACE", "FUNCTION", "METHOD")).select("id", "name")
    size = F.length("import")
    starts = F.sequence(F.lit(1), size)
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("import"), i, n))))
    rows = imports.select("import").distinct().where(F.length("import") > 0).select("import", F.explode(F.array_distinct(pieces)).alias("name"))
    return rows.join(named, "name").select("import", "id")


def symbol_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunks (file, chunk, first_line, last_line) with the symbol of the first line that has one; of a line's symbols the last counts.

    A range join inside each file. symbols: file, line, order and name.
    """
    last = symbols.groupBy("file", "line").agg(F.max_by("name", "order").alias("name"))
    inside = chunks.join(last, "file").where("line between first_line and last_line").groupBy("file", "chunk").agg(F.min_by("name", "line").alias("symbol"))
    return chunks.join(inside, ["file", "chunk"], "left")
