"""Programs: every statement parses, prints and parses again to the same tree."""

import pytest

from mainspring import errors
from mainspring.operators import source
from mainspring.plans import parser

HEAD = "IDENTIFICATION DIVISION. PROGRAM-ID. T. "
STATEMENTS = [
    ("DISPLAY 'A' B(1, 2) C(3:4) UPON CONSOLE WITH NO ADVANCING", "DisplayStatement"), ("MOVE CORRESPONDING A TO B C", "MoveStatement"), ("MOVE ALL '*' TO X OF Y IN Z", "MoveStatement"),
    ("ACCEPT A FROM DATE", "AcceptStatement"), ("CALL 'P' USING BY REFERENCE A BY CONTENT 1 B RETURNING R ON EXCEPTION DISPLAY 'x' END-CALL", "CallStatement"), ("GO TO A", "GoToStatement"), ("GO TO A B C DEPENDING ON N", "GoToStatement"),
    ("CONTINUE", "ContinueStatement"), ("GOBACK", "GobackStatement"), ("IF A = B AND NOT (C > 1 OR D IS NUMERIC) DISPLAY A ELSE NEXT SENTENCE", "IfStatement"), ("IF X IS NOT POSITIVE CONTINUE END-IF", "IfStatement"),
    ("IF (A + B) * 2 >= C OR ON-FLAG DISPLAY 'y' END-IF", "IfStatement"), ("IF A IS GREATER THAN OR EQUAL TO B GOBACK END-IF", "IfStatement"),
    ("PERFORM P1 THRU P2 5 TIMES", "PerformStatement"), ("PERFORM P1 WITH TEST AFTER UNTIL A > 3", "PerformStatement"), ("PERFORM VARYING I FROM 1 BY 1 UNTIL I > 9 AFTER J FROM 1 BY -1 UNTIL J < 0 ADD 1 TO K END-PERFORM", "PerformStatement"), ("PERFORM 3 TIMES DISPLAY 'z' END-PERFORM", "PerformStatement"), ("PERFORM END-PARA", "PerformStatement"), ("PERFORM 1000 THRU 2000", "PerformStatement"), ("GO TO 1000", "GoToStatement"),
    ("ADD A 1 TO B ROUNDED C ON SIZE ERROR DISPLAY 'e' NOT ON SIZE ERROR CONTINUE END-ADD", "ArithmeticStatement"), ("SUBTRACT 1 FROM A GIVING B", "ArithmeticStatement"), ("MULTIPLY A BY B GIVING C ROUNDED", "ArithmeticStatement"), ("DIVIDE A INTO B GIVING C REMAINDER D", "ArithmeticStatement"),
    ("COMPUTE A ROUNDED B = -C ** 2 + (D - 1) / E * FUNCTION MAX(F G)", "ComputeStatement"), ("COMPUTE A = B -1", "ComputeStatement"), ("STOP RUN", "StopStatement"), ("STOP 'wait'", "StopStatement"), ("EXIT PARAGRAPH", "ExitStatement"),
    ("OPEN INPUT F1 REVERSED F2 OUTPUT F3 WITH NO REWIND", "OpenStatement"), ("CLOSE F1 WITH LOCK F2", "CloseStatement"), ("READ F NEXT RECORD INTO R AT END SET EOF TO TRUE NOT AT END CONTINUE END-READ", "ReadStatement"), ("READ F KEY IS K INVALID KEY DISPLAY 'i' END-READ", "ReadStatement"),
    ("WRITE R FROM S AFTER ADVANCING 2 LINES AT END-OF-PAGE DISPLAY 'p' END-WRITE", "WriteStatement"), ("WRITE R BEFORE ADVANCING PAGE", "WriteStatement"), ("REWRITE R FROM S INVALID KEY CONTINUE END-REWRITE", "RewriteStatement"), ("DELETE F RECORD INVALID KEY CONTINUE END-DELETE", "DeleteStatement"), ("START F KEY IS NOT < K INVALID KEY CONTINUE END-START", "StartStatement"),
    ("SORT F ON ASCENDING KEY A B DESCENDING KEY C WITH DUPLICATES IN ORDER COLLATING SEQUENCE IS S USING G GIVING H", "SortStatement"), ("SORT F ON ASCENDING KEY A INPUT PROCEDURE IS P1 THRU P2 OUTPUT PROCEDURE IS P3", "SortStatement"), ("MERGE F ON ASCENDING KEY A USING G H GIVING I", "MergeStatement"), ("RELEASE R FROM S", "ReleaseStatement"), ("RETURN F RECORD INTO R AT END CONTINUE END-RETURN", "ReturnStatement"),
    ("EVALUATE TRUE ALSO A WHEN B > 1 ALSO 1 THRU 5 DISPLAY 'a' WHEN ANY ALSO NOT 7 DISPLAY 'b' WHEN OTHER CONTINUE END-EVALUATE", "EvaluateStatement"), ("INITIALIZE A B WITH FILLER REPLACING NUMERIC DATA BY 0 ALPHANUMERIC BY SPACES", "InitializeStatement"), ("INITIALIZE A ALL TO VALUE THEN TO DEFAULT", "InitializeStatement"),
    ("SET A B TO 3", "SetStatement"), ("SET I UP BY 2", "SetStatement"), ("SET ADDRESS OF A TO P", "SetStatement"), ("SET F TO FALSE", "SetStatement"), ("STRING A DELIMITED BY SIZE B 'c' DELIMITED BY SPACE INTO D WITH POINTER P ON OVERFLOW CONTINUE END-STRING", "StringStatement"),
    ("UNSTRING A DELIMITED BY ALL ',' OR ';' INTO B DELIMITER IN C COUNT IN D E WITH POINTER P TALLYING IN T END-UNSTRING", "UnstringStatement"), ("INSPECT A TALLYING N FOR ALL 'x' BEFORE INITIAL 'y' CHARACTERS M FOR LEADING '0'", "InspectStatement"), ("INSPECT A REPLACING ALL 'x' BY 'y' AFTER 'z' FIRST 'q' BY 'r'", "InspectStatement"), ("INSPECT A CONVERTING 'abc' TO 'ABC' BEFORE '.'", "InspectStatement"),
    ("SEARCH T VARYING I AT END DISPLAY 'n' WHEN A(I) = 1 DISPLAY 'y' WHEN B(I) > 2 CONTINUE END-SEARCH", "SearchStatement"), ("SEARCH ALL T WHEN K(I) = 3 AND L(I) = 4 CONTINUE END-SEARCH", "SearchStatement"),
]


@pytest.mark.parametrize(("text", "kind"), STATEMENTS, ids=[t[:40] for t, _ in STATEMENTS])
def test_statements(text, kind):
    tree = parser.parse(HEAD + f"PROCEDURE DIVISION. MAIN. {text}.")
    assert [k for *_, k, _, _, _ in parser.rows(tree) if k.endswith("Statement")][0] == kind
    shown = parser.print_source(tree)
    again = parser.parse(shown)
    assert tree.same(again) and parser.print_source(again) == shown


PROGRAM = """
IDENTIFICATION DIVISION.
PROGRAM-ID. OUTER.
ENVIRONMENT DIVISION.
CONFIGURATION SECTION.
SOURCE-COMPUTER. BOX WITH DEBUGGING MODE.
OBJECT-COMPUTER. BOX.
SPECIAL-NAMES. DECIMAL-POINT IS COMMA CURRENCY SIGN IS '$'.
INPUT-OUTPUT SECTION.
FILE-CONTROL.
    SELECT OPTIONAL F ASSIGN TO 'f.dat' ORGANIZATION IS INDEXED ACCESS MODE IS DYNAMIC RECORD KEY IS K FILE STATUS IS S.
DATA DIVISION.
FILE SECTION.
FD F.
01 REC. 05 K PIC 9(4). 05 T PIC X(6).
WORKING-STORAGE SECTION.
01 TOTALS. 05 N PIC S9(4) COMP VALUE 0. 88 NONE VALUE 0 THRU 1. 05 A OCCURS 1 TO 5 TIMES DEPENDING ON N PIC X.
LINKAGE SECTION.
77 P PIC X.
PROCEDURE DIVISION USING BY VALUE P RETURNING N.
DECLARATIVES.
ERR SECTION. USE AFTER STANDARD ERROR PROCEDURE ON F.
E1. DISPLAY 'err'.
END DECLARATIVES.
MAIN SECTION 10.
M1. CALL 'inner' USING P. CALL 'other'.
    STOP RUN.
IDENTIFICATION DIVISION.
PROGRAM-ID. INNER.
PROCEDURE DIVISION.
    GOBACK.
END PROGRAM INNER.
END PROGRAM OUTER.
"""


def test_structure():
    tree = parser.parse(PROGRAM)
    kinds = [k for *_, k, _, _, _ in parser.rows(tree)]
    for kind in ("EnvironmentDivision", "SourceComputerParagraph", "DecimalPointClause", "FileControlEntry", "OrganizationClause", "FileDescriptionEntry", "DataDescriptionEntry", "DeclarativeSection", "UseStatement", "Section", "Parameter"):
        assert kind in kinds
    assert kinds.count("Program") == 2 and any(r == "nested" for *_, r, _, _, _, _ in parser.rows(tree))
    shown = parser.print_source(tree)
    assert tree.same(parser.parse(shown)) and parser.print_source(parser.parse(shown)) == shown


@pytest.mark.parametrize(
    ("text", "error"),
    [("", errors.UnexpectedEndOfTokensError), ("FOO.", errors.UnexpectedTokenError), (HEAD + "PROCEDURE DIVISION. MAIN. MOVE A B.", errors.UnexpectedTokenError), (HEAD + "PROCEDURE DIVISION. MAIN. DISPLAY 'a", errors.UnterminatedStringError), (HEAD + "PROCEDURE DIVISION. MAIN. IF A =", errors.UnexpectedEndOfTokensError), (HEAD + "PROCEDURE DIVISION. MAIN. SEARCH ALL T WHEN A > 1 CONTINUE END-SEARCH.", errors.UnexpectedTokenError), (HEAD + "DATA DIVISION. WORKING-STORAGE SECTION. 50 A PIC X.", errors.InvalidLevelNumberError), (HEAD + "PROCEDURE DIVISION. MAIN. DISPLAY ?.", errors.UnexpectedCharacterError)],
)
def test_bad_programs(text, error):
    with pytest.raises(error):
        parser.parse(text)


def test_precedence():
    tree = parser.parse(HEAD + "PROCEDURE DIVISION. M. COMPUTE A = -B ** 2 + C * D - E. IF NOT X = 1 AND Y = 2 OR Z = 3 CONTINUE.")
    top = [n for n in parser.rows(tree) if n[4] in ("BinaryExpr", "LogicalCondition")]
    assert [n[7]["op"] for n in top] == ["-", "+", "**", "*", "OR", "AND"]


def test_source_tables(spark, tmp_path):
    (tmp_path / "a.cob").write_text(PROGRAM)
    (tmp_path / "b.cob").write_text(HEAD + "PROCEDURE DIVISION. M. CALL.")
    (tmp_path / "c.cob").write_text(HEAD + "PROCEDURE DIVISION. M. CALL 'INNER'. GOBACK.")
    files = source.read_source(spark, f"{tmp_path}/[ac].cob")
    nodes = source.ast_nodes(files).cache()
    assert sorted((r.called, r.calls) for r in source.call_graph(nodes).collect()) == [("INNER", 1), ("INNER", 1), ("OTHER", 1)]
    assert {r.kind: r.statements for r in source.verb_counts(nodes).collect()}["CallStatement"] == 3
    assert source.tokens(files).where("type = 'Identifier' AND value = 'CALL'").count() == 3
    assert source.printed(files).count() == 2
    assert source.copybook_entries(spark.createDataFrame([("x", "01 R. 05 A PIC X OCCURS 3.")], "path string, content string")).count() == 2
    bad = source.parse_errors(source.read_source(spark, f"{tmp_path}/*.cob")).collect()
    assert [r.kind for r in bad] == ["UnexpectedTokenError"]


def test_comments_go_to_the_node_that_follows():
    text = "*> about the program\n" + HEAD.replace(". P", ".\nP") + "DATA DIVISION. WORKING-STORAGE SECTION.\n*> an item\n01 A PIC X.\nPROCEDURE DIVISION.\nM.\n*> a sentence\nDISPLAY A. *> last"
    tree = parser.parse(text)
    names = {n[0]: n[4] for n in parser.rows(tree)}
    owners = [(names[n[1]], n[7]["text"]) for n in parser.rows(tree) if n[4] == "Comment"]
    assert owners == [("Program", "about the program"), ("DataDescriptionEntry", "an item"), ("Sentence", "a sentence")]
    shown = parser.print_source(tree)
    assert "*> a sentence\n" in shown and tree.same(parser.parse(shown))
