"""COBOL source as DataFrames: tokens, syntax trees and copybook entries, one task per file.

A source file is small and files are many, so parsing is parallel over files; what crosses
files (call graphs, copybook usage) is then joins and aggregations.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..plans import copybook, lexer, parser

TOKENS = "path string, seq int, line int, col int, type string, value string"
NODES = "path string, node_id int, parent_id int, ordinal int, role string, kind string, line int, col int, attrs map<string, string>"
ENTRIES = "path string, seq int, line int, level int, name string, picture string, usage string, redefines string, occurs_min int, occurs_max int, depending string"


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """path and content of source files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly over the cluster: much source text fits into one split of a compressed table."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _per_file(df: DataFrame, schema: str, make) -> DataFrame:
    """make(content) gives the rows of a file; a file that fails gives none, and its error elsewhere."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows, held = [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if content is None:
                    continue
                rows += [(path, *r) for r in make(content)]
                held += len(content)
                if len(rows) >= 4096 or rows and held >= 1 << 22:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()

    return spread(df.select("path", "content")).mapInArrow(run, schema)


def tokens(df: DataFrame, fixed: bool = False) -> DataFrame:
    """The tokens of source files (path, content)."""
    return _per_file(df, TOKENS, lambda c: [(k, t.line, t.column, t.type, t.value) for k, t in enumerate(lexer.tokenize(c, fixed))])


def _parsed(content: str, fixed: bool, copybooks: dict[str, str] | None, fragment: bool, decimal_comma: bool) -> parser.Node:
    resolver = lexer.map_copybooks(copybooks) if copybooks is not None else None
    return parser.parse(content, fixed, resolver, fragment, decimal_comma, empty=True)


def ast_nodes(df: DataFrame, fixed: bool = False, copybooks: dict[str, str] | None = None, fragment: bool = False, decimal_comma: bool = False) -> DataFrame:
    """The syntax tree of source files, a row per node, parents by id within the file.

    With `fragment` the files are copybooks: data description entries and nothing else. An empty
    source is an empty file.
    """
    return _per_file(df, NODES, lambda c: [(*r[:7], list(r[7].items())) for r in parser.rows(_parsed(c, fixed, copybooks, fragment, decimal_comma))])


def copybook_entries(df: DataFrame, fixed: bool = False, decimal_comma: bool = False) -> DataFrame:
    """The data description entries of copybooks."""
    def make(content):
        for k, e in enumerate(copybook.parse_entries(content, fixed, decimal_comma=decimal_comma)):
            low, high = e.occurs or (None, None)
            yield k, e.line, e.level, e.name, e.picture, e.usage, e.redefines, low, high, e.depending

    return _per_file(df, ENTRIES, lambda c: list(make(c)))


def printed(df: DataFrame, fixed: bool = False, copybooks: dict[str, str] | None = None, fragment: bool = False, decimal_comma: bool = False) -> DataFrame:
    """path and canonical free-format text of source files."""
    return _per_file(df, "path string, text string", lambda c: [(parser.print_source(_parsed(c, fixed, copybooks, fragment, decimal_comma)),)])


def parse_errors(df: DataFrame, fixed: bool = False, copybooks: dict[str, str] | None = None, fragment: bool = False, decimal_comma: bool = False) -> DataFrame:
    """path, kind and message of files that do not parse."""
    def make(content):
        try:
            _parsed(content, fixed, copybooks, fragment, decimal_comma)
        except errors.MainframeError as e:
            yield type(e).__name__, str(e)

    return _per_file(df, "path string, kind string, message string", lambda c: list(make(c)))


def clauses(nodes: DataFrame) -> DataFrame:
    """path, level, name and kind of every data clause with its attributes, from ast_nodes()."""
    entries = nodes.where("kind = 'DataDescriptionEntry'").select("path", F.col("node_id").alias("entry"), F.col("attrs")["level"].alias("level"), F.col("attrs")["name"].alias("name"))
    own = nodes.where("role = 'clause'").select(F.col("path").alias("p"), F.col("parent_id").alias("up"), "ordinal", "kind", "attrs")
    joined = entries.join(own, (F.col("path") == F.col("p")) & (F.col("entry") == F.col("up")))
    return joined.select("path", "entry", "level", "name", "ordinal", "kind", "attrs")


def register_functions(spark: SparkSession) -> None:
    """picture_info(text) as a scalar SQL function, and cobol_tokens(text) and cobol_nodes(text) as table functions."""
    from pyspark.sql.functions import pandas_udf, udtf

    from ..functions import picture

    def info(text):
        try:
            p = picture.parse(text)
        except errors.MainframeError as e:
            return None, None, None, None, None, type(e).__name__
        return p.category, p.digits, p.scale, p.signed, p.size, None

    columns = ["category", "digits", "scale", "signed", "size", "error"]

    @pandas_udf("category string, digits int, scale int, signed boolean, size int, error string")
    def picture_info(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 6 if t is None else info(t) for t in texts], columns=columns, dtype=object)

    @udtf(returnType="seq int, line int, col int, type string, value string")
    class Tokens:
        def eval(self, text: str):
            for k, t in enumerate(lexer.tokenize(text or "")):
                yield k, t.line, t.column, t.type, t.value

    @udtf(returnType="node_id int, parent_id int, ordinal int, role string, kind string, line int, col int, attrs map<string, string>")
    class Nodes:
        def eval(self, text: str):
            yield from parser.rows(_parsed(text or "", False, None, False, False))

    spark.udf.register("picture_info", picture_info)
    spark.udtf.register("cobol_tokens", Tokens)
    spark.udtf.register("cobol_nodes", Nodes)


def call_graph(nodes: DataFrame) -> DataFrame:
    """caller file, called program and number of CALL statements, from ast_nodes()."""
    calls = nodes.where("kind = 'CallStatement'").select("path", F.col("node_id").alias("call"))
    targets = nodes.where("role = 'target' AND kind = 'StringLiteral'").select(F.col("path").alias("p"), "parent_id", F.col("attrs")["value"].alias("literal"))
    joined = calls.join(targets, (calls["path"] == targets["p"]) & (calls["call"] == targets["parent_id"]))
    return joined.groupBy("path", F.upper(F.expr("substring(literal, 2, length(literal) - 2)")).alias("called")).agg(F.count("*").alias("calls"))


def verb_counts(nodes: DataFrame) -> DataFrame:
    """Statements of each kind over all files."""
    return nodes.where(F.col("kind").endswith("Statement")).groupBy("kind").agg(F.count("*").alias("statements"))
