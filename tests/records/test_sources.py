"""Copybooks alone, clause nodes, the decimal comma, error kinds, SQL functions, and the table queries against their SQL."""

from collections import Counter

import duckdb
import pytest

from mainspring import errors
from mainspring.operators import source, table_queries
from mainspring.operators.records import RecordFormat
from mainspring.plans import copybook, lexer, parser

TABLES = "/root/testdata/sf0.001"

BOOK = """*> stock
01 BIN.
   05 CODE-NO PIC X(4).
      88 LOST VALUE 'L1' THRU 'L9' 'XX'.
   05 SHELF OCCURS 1 TO 6 TIMES DEPENDING ON N ASCENDING KEY IS W DESCENDING V INDEXED BY I PIC 9(3).
   05 LEVEL-OF REDEFINES CODE-NO PIC S9(3) SIGN LEADING SEPARATE.
   05 FILLER PIC S9(4) USAGE IS COMPUTATIONAL SYNC RIGHT VALUE -1.
   05 SHOWN PIC ZZ9 BLANK WHEN ZERO JUST GLOBAL EXTERNAL.
66 BOTH RENAMES CODE-NO THRU SHELF.
*> end"""


def test_a_fragment_goes_round_with_a_node_for_each_clause():
    tree = parser.parse(BOOK, fragment=True)
    text = parser.print_source(tree)
    again = parser.parse(text, fragment=True)
    assert tree.same(again) and parser.print_source(again) == text and text.startswith("*> stock\n01 BIN.\n") and text.endswith("*> end\n")
    kinds = Counter(k for *_, k, _, _, _ in parser.rows(tree) if k.endswith("Clause"))
    assert kinds == {"PictureClause": 5, "ValueClause": 2, "OccursClause": 1, "RedefinesClause": 1, "SignClause": 1, "UsageClause": 1, "SynchronizedClause": 1, "BlankWhenZeroClause": 1, "JustifiedClause": 1, "GlobalClause": 1, "ExternalClause": 1, "RenamesClause": 1}
    assert "OCCURS 1 TO 6 TIMES DEPENDING ON N ASCENDING KEY IS W DESCENDING KEY IS V INDEXED BY I" in text and "SIGN IS LEADING SEPARATE CHARACTER" in text and "VALUE 'L1' THROUGH 'L9' 'XX'" in text


def test_a_fragment_holds_entries_only():
    with pytest.raises(errors.TrailingTokenError):
        parser.parse("01 A PIC X. PROCEDURE DIVISION.", fragment=True)
    with pytest.raises(errors.UnexpectedTokenError):
        parser.parse("01 A PIC X.")
    assert parser.print_source(parser.parse("", fragment=True)) == parser.print_source(parser.parse("*", fragment=False, empty=True, fixed=True)) == ""


def test_decimal_comma_from_end_to_end():
    text = "01 A PIC Z.ZZ9,99. 05 B PIC 9,9 VALUE 1,5.".replace("PIC Z.ZZ9,99", "")
    entries = copybook.parse_entries(text, decimal_comma=True)
    assert entries[1].values == [("1,5", None)] and copybook.build(entries, True)[0].children[0].picture.scale == 1
    f = RecordFormat.of(text, "ibm", "ibm", "std", decimal_comma=True)
    assert f.layout.length == 3
    book = lexer.map_copybooks({"B": "05 C PIC 9(2) VALUE 2,5."})
    assert copybook.parse_entries("01 R. COPY B.", resolver=book, decimal_comma=True)[1].values == [("2,5", None)]


HEAD = "IDENTIFICATION DIVISION. PROGRAM-ID. P. PROCEDURE DIVISION. M. "


@pytest.mark.parametrize(("text", "kind"), [("SEARCH ALL T WHEN A > 1 CONTINUE END-SEARCH.", errors.SearchAllConstraintError), ("MOVE A B.", errors.UnexpectedTokenError), ("CLOSE F1. EXIT", errors.UnexpectedEndOfTokensError)])
def test_error_kinds(text, kind):
    with pytest.raises(kind):
        parser.parse(HEAD + text)


def test_a_wrong_keyword_and_an_unknown_node():
    with pytest.raises(errors.UnexpectedKeywordError):
        parser.parse("IDENTIFICATION DIVISION. AUTHOR. P.")
    with pytest.raises(errors.UnsupportedNodeError):
        parser.print_source(parser.Node("File").child("program", parser.Node("Unheard")))


def test_empty_sources_are_empty_files(spark):
    one = spark.createDataFrame([("a", ""), ("b", None)], "path string, content string")
    assert [tuple(r) for r in source.printed(one).collect()] == [("a", "")] and source.parse_errors(one).count() == 0


def test_functions_in_sql(spark):
    source.register_functions(spark)
    row = spark.sql("SELECT i.*, picture_info('9(').error AS wrong, picture_info(CAST(NULL AS STRING)).error AS none FROM (SELECT picture_info('S9(3)V99') AS i)").first()
    assert (row.digits, row.scale, row.signed, row.size, row.error, row.wrong, row.none) == (5, 2, True, 5, None, "RepeatCountError", None)
    assert spark.sql("SELECT count(*) FROM cobol_nodes('" + HEAD.replace("'", "''") + "STOP RUN.') WHERE kind = 'StopStatement'").first()[0] == 1


@pytest.mark.parametrize("name", ["odo_bad_counts", "encode_faults", "variable_file_roundtrip", "fixed_file_roundtrip", "odo_every_line", "fixed_copy_clauses", "float_exact_hfp"])
def test_table_queries(spark, name):
    query, sql = table_queries.queries_and_sql()[name]
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "nation"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    own = query(spark, TABLES)
    found = db.execute(sql)
    columns = [c[0] for c in found.description]
    assert Counter(map(tuple, own.select(*columns).collect())) == Counter(found.fetchall())


@pytest.mark.parametrize(("spec", "form", "targets"), [("GLOBAL AFTER STANDARD ERROR PROCEDURE ON F1 F2", "exception", ["F1", "F2"]), ("AFTER EXCEPTION PROCEDURE INPUT", "exception", ["INPUT"]), ("BEFORE REPORTING R", "reporting", ["R"]), ("FOR DEBUGGING ON P1", "debugging", ["P1"])])
def test_use_forms(spec, form, targets):
    tree = parser.parse(f"IDENTIFICATION DIVISION. PROGRAM-ID. P. PROCEDURE DIVISION. DECLARATIVES. D SECTION. USE {spec}. E. CONTINUE. END DECLARATIVES. M. STOP RUN.")
    rows = list(parser.rows(tree))
    use = next(r for r in rows if r[4] == "UseStatement")
    assert use[7]["form"] == form and [r[7]["value"] for r in rows if r[1] == use[0]] == targets and ("global" in use[7]) == ("GLOBAL" in spec)
    assert f"USE {spec}." in parser.print_source(tree) and tree.same(parser.parse(parser.print_source(tree)))


def test_copybooks_of_a_folder_and_its_libraries(spark):
    files = spark.createDataFrame([("/src/part.cpy", "05 A PIC X."), ("/src/lib/part.cpy", "05 B PIC X."), ("/src/lib/OTHER", "05 C PIC X.")], "path string, content string")
    books = lexer.table_copybooks(files)
    for text, name in (("COPY PART.", "A"), ("COPY PART OF LIB.", "B"), ("COPY other.", "C"), ("COPY 'other' IN lib.", "C")):
        assert [e.name for e in copybook.parse_entries("01 R. " + text, resolver=books)] == ["R", name]
    with pytest.raises(errors.CopyBookNotFoundError):
        copybook.parse_entries("01 R. COPY PART OF NOWHERE.", resolver=books)


def test_sources_of_one_split_are_parsed_by_many_tasks(spark):
    own = spark.range(9000).coalesce(1).selectExpr("string(id) AS path", "IF(id = 7, NULL, '01 a-' || id || ' pic 9.') AS content")
    got = source.printed(own, fragment=True).selectExpr("*", "spark_partition_id() AS task").collect()
    assert len({r["task"] for r in got}) > 1
    assert Counter((r["path"], r["text"]) for r in got) == Counter((str(k), f"01 a-{k} PIC 9.\n") for k in range(9000) if k != 7)


@pytest.mark.parametrize("name", ["occurs_every_line", "odo_every_line"])
def test_lines_of_an_order_share_records(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(table_queries, "DEALT", 100, raising=False)
    rows = [(k, n, k * 7 + n, 1.0) for k in range(50) for n in range(1, 8)] + [(99, n % 9 + 1, n % 3, 2.0) for n in range(1000)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    records, encode = [], table_queries.encode_records
    monkeypatch.setattr(table_queries, "encode_records", lambda df, f: records.append(df) or encode(df, f))
    got = Counter(map(tuple, table_queries.queries_and_sql()[name][0](spark, str(tmp_path)).collect()))
    assert got == Counter((a, b, c, int(d)) for a, b, c, d in rows)
    held = Counter(r["ORDER-KEY"] for r in records[0].select("ORDER-KEY").collect())
    assert all(held[k] == 1 for k in range(50)) and 50 <= held[99] <= 60
