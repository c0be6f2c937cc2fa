"""Pictures, copybooks, layouts, DEPENDING ON, and record files."""

import pytest
from pyspark.sql import functions as F

from mainspring import errors
from mainspring.functions import picture
from mainspring.operators.records import RecordFormat, decode_records, encode_records
from mainspring.plans import copybook, lexer
from mainspring.plans.layout import GNUCOBOL, IBM, Dialect, lay_out
from mainspring.sources import records as source
from mainspring.streaming import records as streaming


@pytest.mark.parametrize(
    ("text", "want"),
    [("9(5)", (5, 0, False, 5, "numeric")), ("S9(3)V9(2)", (5, 2, True, 5, "numeric")), ("V9(5)", (5, 5, False, 5, "numeric")), ("9(5)PPP", (5, -3, False, 5, "numeric")), ("PPP9(5)", (5, 8, False, 5, "numeric")), ("SPPP99", (2, 5, True, 2, "numeric")), ("a(4)", (0, 0, False, 4, "alphabetic")), ("A9", (0, 0, False, 2, "alphanumeric")), ("ZZ,ZZ9.99", (7, 2, False, 9, "numeric-edited")), ("XBX/0", (0, 0, False, 5, "alphanumeric-edited")), ("+++9", (3, 0, False, 4, "numeric-edited")), ("9(3)CR", (3, 0, False, 5, "numeric-edited")), ("9(5)P", (5, -1, False, 5, "numeric"))],
)
def test_pictures(text, want):
    p = picture.parse(text)
    assert (p.digits, p.scale, p.signed, p.size, p.category) == want


def test_decimal_comma():
    assert picture.parse("Z.ZZ9,99", True).scale == 2 and picture.parse("9,99", True).digits == 3


@pytest.mark.parametrize(
    ("text", "error"),
    [("", errors.EmptyPictureError), ("Q", errors.UnexpectedSymbolError), ("9(0)", errors.RepeatCountError), ("9(65536)", errors.RepeatCountError), ("9(", errors.RepeatCountError), ("9S", errors.SymbolPlacementError), ("9V9V", errors.SymbolPlacementError), ("9.9.", errors.SymbolPlacementError), ("9V.9", errors.SymbolPlacementError), ("Z*", errors.SymbolPlacementError), ("CR9", errors.SymbolPlacementError), ("+9-", errors.SymbolPlacementError), ("+9CR", errors.SymbolPlacementError), ("9P9", errors.SymbolPlacementError), ("X+", errors.CategoryError), ("SX", errors.CategoryError), ("SV", errors.CategoryError), ("+", errors.CategoryError)],
)
def test_bad_pictures(text, error):
    with pytest.raises(error):
        picture.parse(text)


MEMBER = """
01 MEMBER.
   05 NO PIC 9(5).
   05 FAMILY-NAME PIC X(20).
   05 DUES PIC S9(5)V99 COMP-3.
   05 STANDING PIC X(2).
      88 PAID VALUE 'PD'.
      88 ARREARS VALUES 'A1' 'A2'.
   05 VISIT OCCURS 4 TIMES.
      10 PLACE PIC X(12).
      10 MINUTES PIC 9(7) COMP.
66 NAME-AND-DUES RENAMES FAMILY-NAME THRU DUES.
77 TOTAL-VISITS PIC 9(6).
"""


def spans(source_, dialect=IBM, index=0):
    return [(r["name"], r["offset"], r["length"], r["occurs"]) for r in lay_out(copybook.records(source_)[index], dialect).rows()]


def test_layout():
    assert spans(MEMBER) == [("MEMBER", 0, 95, 1), ("NO", 0, 5, 1), ("FAMILY-NAME", 5, 20, 1), ("DUES", 25, 4, 1), ("STANDING", 29, 2, 1), ("VISIT", 31, 16, 4), ("PLACE", 31, 12, 1), ("MINUTES", 43, 4, 1)]
    record, alone = copybook.records(MEMBER)
    assert [f.name for f in record.aliases[0].fields] == ["FAMILY-NAME", "DUES"] and alone.name == "TOTAL-VISITS"
    own = lay_out(record, IBM)
    assert own.find("standing").at.value(None) == 29 and own.find("nothing") is None
    assert own.occurrence_offset(own.find("VISIT"), 2) == 63
    with pytest.raises(errors.OccurrenceError):
        own.occurrence_offset(own.find("VISIT"), 4)


def test_sync():
    text = "01 R. 05 A PIC X. 05 B PIC 9(9) COMP SYNC. 05 C OCCURS 2. 10 D PIC X. 10 E PIC 9(4) COMP SYNC. 05 F COMP-2 SYNC."
    assert spans(text) == [("R", 0, 24, 1), ("A", 0, 1, 1), ("B", 4, 4, 1), ("C", 8, 4, 2), ("D", 8, 1, 1), ("E", 10, 2, 1), ("F", 16, 8, 1)]
    assert spans(text, GNUCOBOL)[-1] == ("F", 11, 8, 1)
    rows = lay_out(copybook.records(text)[0], IBM).rows()
    assert [r["slack"] for r in rows] == [0, 0, 3, 0, 0, 1, 0]


def test_redefines():
    longer = "01 R. 05 A PIC X(2). 05 B REDEFINES A PIC X(4). 05 C PIC X."
    assert spans(longer, GNUCOBOL) == [("R", 0, 5, 1), ("A", 0, 2, 1), ("B", 0, 4, 1), ("C", 4, 1, 1)]
    with pytest.raises(errors.RedefinesError):
        spans(longer)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("01 R. 05 A PIC X OCCURS 1 TO 3.", errors.OccursError), ("01 R. 05 A PIC X OCCURS 0.", errors.OccursError),
        ("01 R. 05 A PIC X OCCURS 3 DEPENDING ON N. 05 N PIC 9.", errors.DependingError), ("01 R. 05 N PIC X. 05 A PIC X OCCURS 3 DEPENDING ON N.", errors.DependingError),
        ("01 R. 05 N PIC 9V9. 05 A PIC X OCCURS 3 DEPENDING ON N.", errors.DependingError), ("01 R. 05 N PIC 9. 05 A PIC X OCCURS 5 TO 3 DEPENDING ON N.", errors.OccursError),
        ("01 R. 05 A REDEFINES B PIC X.", errors.RedefinesError), ("01 R. 05 A PIC X COMP-3.", errors.LayoutError), ("01 R. 05 A.", errors.LayoutError),
        ("01 R. 05 A PIC S9 COMP-6.", errors.LayoutError), ("01 R PIC X. 05 A PIC X.", errors.LevelSequenceError), ("05 A PIC X.", errors.LevelSequenceError),
        ("01 R. 05 A PIC 9 COMP-1.", errors.UsageError), ("01 R. 05 A PIC Q.", errors.PictureError), ("88 C VALUE 1.", errors.LevelSequenceError),
        ("01 R. 05 A PIC X. 66 B RENAMES Q.", errors.RenamesError), ("01 R. 05 A PIC X. 05 B PIC X. 66 C RENAMES B THRU A.", errors.RenamesError),
        ("50 A PIC X.", errors.InvalidLevelNumberError), ("01 R. 05 A REDEFINES R PIC X.", errors.RedefinesError), ("01 R. 05 A PIC X", errors.UnexpectedEndOfTokensError),
        ("01 R. 05 A WRONG.", errors.UnexpectedTokenError), ("01 R. FOO.", errors.TrailingTokenError), ("01 R PIC X. 01 'abc", errors.UnterminatedStringError),
    ],
)
def test_bad_copybooks(text, error):
    with pytest.raises(error):
        lay_out(copybook.records(text)[0], IBM)


def test_dialects_are_checked():
    for bad in (Dialect("x", "aligned", "strict", 4, 4), Dialect("full", "", "strict", 4, 4), Dialect("full", "aligned", "", 4, 4), Dialect("full", "aligned", "strict", 0, 4)):
        with pytest.raises(errors.DialectError):
            bad.validate()


ODO = "01 R. 05 N PIC %s. 05 A PIC X(3) OCCURS 1 TO 5 DEPENDING ON N. 05 TAIL PIC X(4)."


def test_depending_on():
    own = lay_out(copybook.records(ODO % "9(2)")[0], IBM)
    assert (own.length, own.min_length, own.max_length, own.variable) == (0, 9, 21, True)
    for n, tail in ((1, 5), (3, 11), (5, 17)):
        assert own.rows({"A": n})[-1]["offset"] == tail
    for n in (0, 6):
        with pytest.raises(errors.DependingError):
            own.rows({"a": n})


@pytest.mark.parametrize(("control", "h", "n"), [("9(2)", "F0F4", 4), ("9(2)", "3034", 4), ("S9(2)", "F0C2", 2), ("S9(2) SIGN LEADING SEPARATE", "2B3033", 3), ("S9(3) COMP-3", "002F", 2), ("9(3) COMP-6", "0002", 2)])
def test_counts_are_read_whatever_the_encoding(spark, control, h, n):
    f = RecordFormat.of(ODO % control, "ibm", "ibm", "std")
    raw = bytearray.fromhex(h + "C1C2C3" * n + "E3C1C9D3")
    row = decode_records(spark.createDataFrame([(raw,)], "value binary"), f.__class__(f.layout, f.encoding, "std"), mode="PERMISSIVE").first()
    assert row.A == ["ABC"] * n and row.TAIL == "TAIL"


@pytest.mark.parametrize("h", ["F0F0", "F0F6", "F0FA", "C1C2"])
def test_bad_counts_are_faults(spark, h):
    f = RecordFormat.of(ODO % "9(2)", "ibm", "ibm", "std")
    row = decode_records(spark.createDataFrame([(bytearray.fromhex(h + "C1" * 19),)], "value binary"), f, mode="PERMISSIVE").first()
    assert row._faults and row._faults[0].field == "N"


@pytest.mark.parametrize(("control", "h"), [("9(2) COMP-3", "0ABC"), ("9(2) COMP-3", "0000"), ("9(3) COMP-6", "0BBB"), ("S9(2)", "F111"), ("9(2) COMP", "FFFF"), ("9(2) COMP", "0006")])
def test_bad_counts_of_every_usage(spark, control, h):
    f = RecordFormat.of(ODO % control, "ibm", "ibm", "std")
    frame = spark.createDataFrame([(bytearray.fromhex(h + "C1" * 19),)], "value binary")
    row = decode_records(frame, f, mode="PERMISSIVE").first()
    assert [x.field for x in row._faults] == ["N"]
    assert decode_records(frame, f, mode="DROPMALFORMED").count() == 0


def test_two_tables_and_sync_after_one(spark):
    text = "01 R. 05 N PIC 9. 05 M PIC 9. 05 A PIC X OCCURS 0 TO 3 DEPENDING ON N. 05 B OCCURS 0 TO 2 DEPENDING ON M. 10 C PIC 9. 10 D PIC X(2) OCCURS 2. 05 E PIC S9(4) COMP SYNC."
    f = RecordFormat.of(text, "ibm", "ibm", "std")
    rows = [(n, m, ["x"] * n, [(k, ["ab", "cd"]) for k in range(m)], -n) for n in range(4) for m in range(3)]
    for n, m, a, b, e in rows:
        parts = bytes([0xF0 + n, 0xF0 + m]) + b"\xa7" * n + b"".join(bytes([0xF0 + k]) + "abcd".encode("cp037") for k, _ in b)
        raw = bytearray(parts + b"\0" * (len(parts) % 2) + e.to_bytes(2, "big", signed=True))
        got = decode_records(spark.createDataFrame([(raw,)], "value binary"), f).first()
        assert (got.N, got.M, got.A, [(x.C, x.D) for x in got.B], got.E) == (n, m, a, b, e)


def test_conditions_and_aliases(spark):
    f = RecordFormat.of(MEMBER, "ibm", "ibm", "std", record="MEMBER")
    frame = spark.createDataFrame([(7, "Ann", 1, "PD", [("L", 9)] * 4), (8, "Bob", 2, "A2", [("M", 8)] * 4)], "NO int, `FAMILY-NAME` string, DUES int, STANDING string, VISIT array<struct<PLACE: string, MINUTES: int>>")
    raw = encode_records(frame, f)
    assert raw.select(F.length("value")).distinct().collect()[0][0] == 95
    rows = decode_records(raw, f, conditions=True, aliases=True).orderBy("NO").collect()
    assert [(r["PAID"], r["ARREARS"], len(r["NAME-AND-DUES"])) for r in rows] == [(True, False, 24), (False, True, 24)]
    assert rows[0]["VISIT"][2]["MINUTES"] == 9


CODED = """
01 R.
   05 N PIC 9.
   05 BOX OCCURS 1 TO 3 DEPENDING ON N.
      88 EMPTY-BOX VALUE SPACES.
      10 KIND PIC X(2).
         88 NAMED VALUE 'A' THRU 'IZ' '00' '1   '.
         88 LOWEST VALUE LOW-VALUES.
         88 STARS VALUE ALL '*'.
         88 TOO-LONG VALUE 'ABC'.
      10 AMOUNT PIC S9(2) OCCURS 2.
         88 NONE VALUE ZERO.
         88 SMALL VALUES -5 THRU 5, 50.
         88 NEVER VALUE SPACE.
"""


def test_conditions_in_tables_and_of_groups(spark):
    f = RecordFormat.of(CODED, "ibm", "ibm", "std")
    text = lambda t: t.encode("cp037")
    rows = [b"\xf3" + text("B ") + text("0E") + text("50") + text("00") + text("0500") + text("1 ") + text("06") + text("0N"), b"\xf1" + text(" " * 6), b"\xf2" + b"\0\0" + text("0000") + text("**") + text("9999")]
    frame = spark.createDataFrame([(bytearray(r),) for r in rows], "value binary")
    a, b, c = decode_records(frame, f, mode="PERMISSIVE", conditions=True).collect()
    assert a["NAMED"] == [True, True, True] and a["EMPTY-BOX"] == [False] * 3
    assert a["SMALL"] == [[True, True], [True, True], [False, True]] and a["NONE"] == [[False, False], [False, True], [False, False]]
    assert b["EMPTY-BOX"] == [True] and b["NAMED"] == [False] and b["SMALL"] == [[None, None]]
    assert c["LOWEST"] == [True, False] and c["STARS"] == [False, True] and c["TOO-LONG"] == [False, False] and c["NEVER"] == [[False, False]] * 2


def test_ranges_follow_the_charset(spark):
    text, value = "01 R. 05 K PIC X. 88 LETTER-OR-DIGIT VALUE 'A' THRU '9'.", "A5 "
    for encoding, want in (("ibm", [True, True, False]), ("gnucobol", [False, False, False])):
        f = RecordFormat.of(text, encoding, encoding, "std")
        frame = spark.createDataFrame([(k, v) for k, v in enumerate(value)], "n int, K string")
        rows = decode_records(encode_records(frame, f, keep=("n",)), f, keep=("n",), conditions=True).orderBy("n").collect()
        assert [r["LETTER-OR-DIGIT"] for r in rows] == want


def test_integral_types(spark):
    f = RecordFormat.of("01 R. 05 A PIC S9(9) COMP-3. 05 B PIC 9(10). 05 C PIC 9(4) COMP. 05 D PIC 9(19) COMP-3. 05 E PIC 9(3)V9. 05 T PIC 9(2) OCCURS 5.", "ibm", "ibm", "std", integral=True)
    frame = spark.createDataFrame([(-123456789, 9876543210, 1234, "2345678901234567890", 12.5, [1, 2, 3, 4, 5])], "A long, B long, C int, D string, E double, T array<int>")
    out = decode_records(encode_records(frame, f), f)
    assert [t for _, t in out.dtypes] == ["int", "bigint", "int", "decimal(19,0)", "decimal(4,1)", "array<int>"]
    row = out.first()
    assert (row.A, row.B, row.C, float(row.E), row["T"]) == (-123456789, 9876543210, 1234, 12.5, [1, 2, 3, 4, 5])


def test_record_files(spark, tmp_path):
    f = RecordFormat.of("01 R. 05 K PIC 9(9) COMP. 05 T PIC X(5).", "ibm", "ibm", "std")
    frame = spark.range(1001).select(F.col("id").alias("K"), F.concat(F.lit("t"), F.col("id") % 10).alias("T"))
    source.write_records(frame.repartition(3), f, f"{tmp_path}/fixed")
    back = source.read_records(spark, f"{tmp_path}/fixed/part-*", f)
    assert sorted((r.K, r.T) for r in back.collect()) == [(i, f"t{i % 10}") for i in range(1001)]
    odo = RecordFormat.of(ODO % "9(2)", "ibm", "ibm", "std")
    rows = spark.range(50).select((F.col("id") % 5 + 1).cast("int").alias("N"), F.array_repeat(F.lit("abc"), (F.col("id") % 5 + 1).cast("int")).alias("A"), F.col("id").cast("string").alias("TAIL"))
    source.write_records(rows.coalesce(1), odo, f"{tmp_path}/odo")
    got = source.read_records(spark, f"{tmp_path}/odo/part-*", odo).collect()
    assert sorted((r.N, len(r.A), int(r.TAIL)) for r in got) == sorted((i % 5 + 1, i % 5 + 1, i) for i in range(50))


@pytest.mark.parametrize("control", ["9(2)", "9(2) COMP", "9(2) COMP-3"])
def test_long_files_are_streamed(spark, tmp_path, monkeypatch, control):
    monkeypatch.setattr(source, "PIECE", 64)
    f = RecordFormat.of(ODO.replace("1 TO 5", "1 TO 20") % control, "ibm", "ibm", "std")
    n = (F.col("id") % 20 + 1).cast("int")
    rows = spark.range(300).select(n.alias("N"), F.array_repeat(F.lit("abc"), n).alias("A"), F.col("id").cast("string").alias("TAIL"))
    source.write_records(rows.coalesce(1), f, f"{tmp_path}/odo")
    for whole in (1 << 20, 0):
        got = decode_records(source.read_variable(spark, f"{tmp_path}/odo/part-*", f, whole), f, keep=("seq",)).orderBy("seq").collect()
        assert [(r.seq, r.N, len(r.A), int(r.TAIL)) for r in got] == [(i, i % 20 + 1, i % 20 + 1, i) for i in range(300)]
    (tmp_path / "odo" / "part-00000").open("ab").write(b"\xf0")
    with pytest.raises(Exception, match="ends beyond the file|occurrences of A"):
        source.read_variable(spark, f"{tmp_path}/odo/part-*", f, 0).collect()


def test_variable_stream(spark, tmp_path):
    f = RecordFormat.of(ODO % "9(2)", "ibm", "ibm", "std")
    n = (F.col("id") % 5 + 1).cast("int")
    source.write_records(spark.range(50).select(n.alias("N"), F.array_repeat(F.lit("abc"), n).alias("A"), F.lit("x").alias("TAIL")).coalesce(1), f, f"{tmp_path}/in")
    query = streaming.read_stream(spark, f"{tmp_path}/in", f, glob="part-*").groupBy("N").agg(F.sum(F.size("A")).alias("k")).writeStream.outputMode("complete").format("memory").queryName("variable").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(map(int, r)) for r in spark.sql("SELECT N, k FROM variable").collect()) == [(k, 10 * k) for k in range(1, 6)]


def test_stream(spark, tmp_path):
    f = RecordFormat.of("01 R. 05 K PIC 9(4) COMP. 05 T PIC X(2).", "ibm", "ibm", "std")
    source.write_records(spark.range(30).select(F.col("id").alias("K"), F.lit("ab").alias("T")).coalesce(1), f, f"{tmp_path}/in")
    query = streaming.read_stream(spark, f"{tmp_path}/in", f, glob="part-*").groupBy("T").agg(F.sum("K").alias("k")).writeStream.outputMode("complete").format("memory").queryName("records").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT T, int(k) FROM records").collect()] == [("ab", 435)]


@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_long_files_of_a_stream_are_split(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(source, "STRETCH", 600, raising=False)
    monkeypatch.setattr(source, "PIECE", 64)
    f = RecordFormat.of("01 R. 05 K PIC 9(4) COMP. 05 T PIC X(2).", "ibm", "ibm", "std")
    source.write_records(spark.range(1000).select(F.col("id").alias("K"), F.lit("ab").alias("T")).coalesce(1), f, f"{tmp_path}/in")
    (own,) = (tmp_path / "in").glob("part-*")
    own.write_bytes(own.read_bytes()[:-1])  # the last record is short
    got = []
    rows = streaming.read_stream(spark, f"{tmp_path}/in", f, glob="part-*", **({"whole": whole} if whole else {})).withColumn("task", F.spark_partition_id())
    query = rows.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    got.sort(key=lambda r: r["_seq"])
    assert [(r["_seq"], r["_offset"], int(r["K"]), len(r["_faults"])) for r in got] == [(k, 4 * k, k, int(k == 999)) for k in range(1000)]
    assert whole or len({r["task"] for r in got}) > 1


def test_tokens():
    got = [(t.type, t.value) for t in lexer.tokenize("MOVE -1.5 TO A(2). *> x\nIF A >= 'it''s' ==:T:==")]
    assert got == [("Identifier", "MOVE"), ("Number", "-1.5"), ("Identifier", "TO"), ("Identifier", "A"), ("Symbol", "("), ("Number", "2"), ("Symbol", ")"), ("Symbol", "."), ("Comment", "*> x"), ("Identifier", "IF"), ("Identifier", "A"), ("Symbol", ">="), ("String", "'it''s'"), ("PseudoText", "==:T:==")]


def test_fixed_format():
    lines = ["000100* note", "000200 01  A PIC X(3) VALUE 'a", "000300-    'b'.", "000400D    DISPLAY X", "000500     05 B PIC 9."]
    got = [(t.line, t.type, t.value) for t in lexer.tokenize("\n".join(line.ljust(72) + "IGNORED" for line in lines), fixed=True)]
    assert (1, "Comment", "* note") in got and any(t[1] == "Debug" for t in got)
    text = next(v for _, k, v in got if k == "String")
    assert text.startswith("'a") and text.endswith("b'") and len(text) == 72 - 28 + 2


def test_copy():
    books = lexer.map_copybooks({"PART": "05 :P:-A PIC X. COPY INNER.", "inner": "05 B PIC 9.", "LOOP": "COPY LOOP.", "LIB.PART": "05 L PIC X."})
    entries = copybook.parse_entries("01 R. COPY PART REPLACING ==:P:-A== BY ==Q-A==. 05 Z PIC X.".replace(":P:-A", "OLD"), resolver=lexer.map_copybooks({"PART": "05 OLD PIC X. COPY INNER.", "INNER": "05 B PIC 9."}))
    assert [e.name for e in entries] == ["R", "Q-A", "B", "Z"]
    assert [e.name for e in copybook.parse_entries("01 R. COPY PART IN LIB.", resolver=books)] == ["R", "L"]
    for text, resolver, error in (("COPY NONE.", books, errors.CopyBookNotFoundError), ("COPY LOOP.", books, errors.CopyBookCycleError), ("COPY PART.", None, errors.MissingCopyBookResolverError), ("COPY PART", books, errors.UnexpectedEndOfTokensError)):
        with pytest.raises(error):
            copybook.parse_entries(text, resolver=resolver)
