"""Counts that are not to be believed, values that do not fit, and part files that come whole or not at all."""

import os
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mainspring.functions.encoding import Encoding
from mainspring.operators.records import RecordFormat, decode_records, encode_records
from mainspring.plans.layout import IBM, Dialect
from mainspring.sources import records as source

ODO = "01 R. 05 HEAD PIC X. 05 N PIC %s. 05 A PIC X(3) OCCURS %s DEPENDING ON N. 05 TAIL PIC X(4)."


def raw(spark, *rows):
    return spark.createDataFrame([(k, bytearray.fromhex(h)) for k, h in enumerate(rows)], "k int, value binary")


@pytest.mark.parametrize(("control", "h"), [("9(2)", "F0F7"), ("9(2)", "F0FA"), ("9(2)", "F0F0"), ("S9(2)", "F0D2"), ("9(2) COMP-3", "007D"), ("9(3) COMP-6", "0BBB"), ("9(2) COMP", "0007"), ("S9(2) COMP", "FFFF")])
def test_a_bad_count_fails_or_nulls_all_behind_it(spark, control, h):
    f = RecordFormat.of(ODO % (control, "1 TO 5"), "ibm", "ibm", "std")
    frame = raw(spark, "C1" + h + "C1" * 19)
    strict = decode_records(frame, f)
    assert strict.select("HEAD").first()[0] == "A"
    for name in ("A", "TAIL"):
        with pytest.raises(PySparkException, match="N: no count of 1 to 5 A"):
            strict.select(name).collect()
    row = decode_records(frame, f, mode="PERMISSIVE").first()
    assert (row.HEAD, row.A, row.TAIL) == ("A", None, None) and [x.field for x in row._faults] == ["N"]
    assert decode_records(frame, f, mode="DROPMALFORMED").count() == 0


def test_a_short_record_has_no_count(spark):
    f = RecordFormat.of(ODO % ("9(2)", "0 TO 5"), "ibm", "ibm", "std")
    frame = raw(spark, "C1F0")
    row = decode_records(frame, f, mode="PERMISSIVE").first()
    assert (row.HEAD, row.N, row.A, row.TAIL) == ("A", None, None, None) and {x.field for x in row._faults} == {"N"}
    with pytest.raises(PySparkException, match="no count"):
        decode_records(frame, f).select("TAIL").collect()


@pytest.mark.parametrize("sign", ["ebcdic", "zone37", "translated", "realia"])
@pytest.mark.parametrize("clause", ["S9(2)", "S9(2) SIGN LEADING", "S9(2) SIGN TRAILING SEPARATE", "9(2)"])
def test_counts_go_round_in_every_sign_convention(spark, tmp_path, sign, clause):
    charset = "cp037" if sign == "ebcdic" else "ascii"
    f = RecordFormat.of(ODO % (clause, "0 TO 20"), IBM, Encoding(charset, sign, "big", "ieee", "2-4-8"), "std")
    rows = spark.range(21).select(F.lit("h").alias("HEAD"), F.col("id").cast("int").alias("N"), F.array_repeat(F.lit("abc"), F.col("id").cast("int")).alias("A"), F.col("id").cast("string").alias("TAIL"))
    got = decode_records(encode_records(rows, f), f).collect()
    assert sorted((int(r.N), r.A, int(r.TAIL)) for r in got) == [(n, ["abc"] * n, n) for n in range(21)]
    source.write_records(rows.coalesce(2), f, f"{tmp_path}/odo")
    got = source.read_records(spark, f"{tmp_path}/odo/part-*", f).collect()
    assert sorted((int(r.N), len(r.A), int(r.TAIL)) for r in got) == [(n, n, n) for n in range(21)]


def encoded(spark, clause, value, kind, **options):
    f = RecordFormat.of(f"01 R. 05 V {clause}.", Dialect("2-4-8", "ignored", "lenient", 4, 8), Encoding("ascii", "zone37", "big", "ieee", "2-4-8"), "std")
    return encode_records(spark.createDataFrame([(value,)], f"V {kind}"), f, **options).first()


WRONG = [
    ("PIC 9(4)", 0.5, "double", "scale"), ("PIC V99", 1.239, "double", "zoned_range"), ("PIC 9V99", 1.239, "double", "scale"), ("PIC 9V99", Decimal("1.239"), "decimal(9,3)", "scale"),
    ("PIC 9(3)PP", 1250, "int", "scale"), ("PIC 9(4)", "1.5", "string", "scale"), ("PIC S9(20) COMP-3", Decimal("1.5"), "decimal(30,1)", "scale"), ("PIC 9(4)", None, "int", "null_value"),
    ("PIC X(4)", None, "string", "null_value"), ("COMP-2", None, "double", "null_value"), ("PIC X(4)", "abcde", "string", "field_too_long"), ("PIC X(4)", "日本", "string", "unrepresentable_character"),
    ("PIC 9(3)", 1000, "int", "zoned_range"), ("PIC 9(3) COMP-3", -1, "long", "packed_range"), ("PIC 9(4) COMP", 10000, "int", "binary_range"), ("COMP-1", 1e300, "double", "float_range"),
    ("PIC X OCCURS 2", ["a", "b", "c"], "array<string>", "occurs_count"), ("PIC 9(2) COMP-3", 10**30, "decimal(38,0)", "packed_range"),
]


@pytest.mark.parametrize(("clause", "value", "kind", "fault"), WRONG)
def test_what_does_not_fit_is_never_cut(spark, clause, value, kind, fault):
    value = Decimal(value) if kind.startswith("decimal") else value
    with pytest.raises(PySparkException, match="V: "):
        encoded(spark, clause, value, kind)
    row = encoded(spark, clause, value, kind, mode="PERMISSIVE")
    assert row.value is None and [tuple(x) for x in row._faults] == [("V", fault)]


@pytest.mark.parametrize(("clause", "value", "kind", "h"), [("PIC 9V99", 1.23, "double", "313233"), ("PIC 9(3)PP", 1200, "int", "303132"), ("PIC 9(3)V9", 7, "int", "30303730"), ("PIC 9(2)", "12", "string", "3132"), ("PIC S9(9)V99 COMP-3", Decimal("-0.1"), "decimal(5,1)", "00000000010D")])
def test_what_fits_exactly_is_written(spark, clause, value, kind, h):
    row = encoded(spark, clause, value, kind, mode="PERMISSIVE")
    assert bytes(row.value).hex().upper() == h and row._faults == []


@pytest.mark.parametrize(("clause", "kind", "h"), [("PIC 9(3)", "int", "303030"), ("PIC X(2)", "string", "2020"), ("COMP-1", "float", "00000000"), ("PIC 9 OCCURS 2", "array<int>", "3030"), ("PIC S9(3) COMP-3", "decimal(3,0)", "000C")])
def test_nulls_are_filled_on_request(spark, clause, kind, h):
    assert bytes(encoded(spark, clause, None, kind, nulls="fill").value).hex().upper() == h
    with pytest.raises(ValueError, match="nulls"):
        encoded(spark, clause, None, kind, nulls="some")


def test_a_table_has_as_many_elements_as_its_count(spark):
    f = RecordFormat.of("01 R. 05 H. 10 N PIC 9. 05 A OCCURS 0 TO 3 DEPENDING ON N. 10 B PIC 9(2). 05 T PIC X.", "ibm", "ibm", "std")
    rows = [((2,), [(1,), (2,)], "x"), ((2,), [(1,), (2,), (3,)], "x"), ((0,), [(1,)], "x"), ((3,), [], "x"), ((4,), [(1,)] * 4, "x"), ((1,), [(None,)], "x")]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, H struct<N: int>, A array<struct<B: int>>, T string")
    got = encode_records(frame, f, ("k",), mode="PERMISSIVE").orderBy("k").collect()
    assert [[tuple(x) for x in r._faults] for r in got] == [[], [("A", "occurs_count")], [("A", "occurs_count")], [("A", "occurs_count")], [("A", "occurs_count")], [("B", "null_value")]]
    assert bytes(got[0].value).hex().upper() == "F2F0F1F0F2A7" and [r.value is None for r in got] == [False] + [True] * 5
    with pytest.raises(PySparkException, match="A: the elements do not fit"):
        encode_records(frame.where("k = 1"), f).collect()


@pytest.mark.parametrize("floats", ["ieee", "hfp"])
def test_floats_go_round_exactly(spark, floats):
    import random
    import struct

    rng = random.Random(7)
    f = RecordFormat.of("01 R. 05 S COMP-1. 05 D COMP-2.", Dialect("2-4-8", "ignored", "lenient", 4, 8), Encoding("ascii", "zone37", "little", floats, "2-4-8"), "std")
    rows = [0.0, 1.0, -1.0, 0.1, 1 / 3, 1e-70, -9.999e70, 16.0, 15.999999, 5.4e-79] + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-60, 60) for _ in range(200)]
    singles = [struct.unpack(">f", struct.pack(">f", x if abs(x) < 3e38 and (x == 0 or abs(x) > 1e-37) else 1.5))[0] for x in rows]
    frame = spark.createDataFrame([(k, s, d) for k, (s, d) in enumerate(zip(singles, rows, strict=True))], "k int, S float, D double")
    got = decode_records(encode_records(frame, f, ("k",)), f, keep=("k",)).orderBy("k").collect()
    assert [r.D for r in got] == rows
    if floats == "ieee":
        assert [r.S for r in got] == singles
    else:
        assert all(abs(r.S - s) <= abs(s) * 2**-20 for r, s in zip(got, singles, strict=True))
    if floats == "hfp":
        for bad in (float("inf"), float("nan"), 1e80, 1e-300):
            with pytest.raises(PySparkException, match="D: the number does not fit the floating"):
                encode_records(spark.createDataFrame([(1.0, bad)], "S float, D double"), f).collect()


FLAT = "01 R. 05 K PIC 9(9) COMP. 05 T PIC X(5)."


def test_writing_appends_overwrites_or_refuses(spark, tmp_path):
    f, path = RecordFormat.of(FLAT, "ibm", "ibm", "std"), f"{tmp_path}/out"
    rows = lambda a, b: spark.range(a, b, 1, 3).select(F.col("id").alias("K"), F.lit("x").alias("T"))
    assert source.write_records(rows(0, 10), f, path) == 10 and source.write_records(rows(10, 25), f, path) == 15
    back = lambda: sorted(r.K for r in source.read_records(spark, f"{path}/part-*", f).collect())
    assert back() == list(range(25))
    with pytest.raises(FileExistsError):
        source.write_records(rows(0, 1), f, path, mode="error")
    source.write_records(rows(50, 53), f, path, mode="overwrite")
    assert back() == [50, 51, 52]
    assert source.write_records(rows(0, 0), f, path) == 0 and back() == [50, 51, 52]


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    f, path = RecordFormat.of(FLAT, "ibm", "ibm", "std"), f"{tmp_path}/out"
    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("K"), F.when(F.col("id") == 99, "too long").otherwise("x").alias("T"))
    with pytest.raises(PySparkException):
        source.write_records(rows, f, path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_an_index_splits_variable_files(spark, tmp_path, monkeypatch):
    f = RecordFormat.of(ODO % ("9(2)", "1 TO 20"), "ibm", "ibm", "std")
    n = (F.col("id") % 20 + 1).cast("int")
    rows = spark.range(300).select(F.lit("h").alias("HEAD"), n.alias("N"), F.array_repeat(F.lit("abc"), n).alias("A"), F.col("id").cast("string").alias("TAIL"))
    source.write_records(rows.repartition(2), f, f"{tmp_path}/odo")
    index = source.index_variable(spark, f"{tmp_path}/odo/part-*", f, stretch=500)
    own = index.collect()
    assert len(own) > 10 and sum(r["size"] for r in own) == sum(os.path.getsize(f"{tmp_path}/odo/{x}") for x in os.listdir(f"{tmp_path}/odo") if x.startswith("part-"))
    cut = source.read_variable(spark, None, f, index=index)
    assert cut.rdd.getNumPartitions() > 1
    got = decode_records(cut, f, keep=("offset",)).collect()
    assert sorted(int(r.TAIL) for r in got) == list(range(300)) and len({r.offset for r in got}) > 150
