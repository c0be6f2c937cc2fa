"""Byte vectors of every format, faults, and what must not be written."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mainspring import errors
from mainspring.functions.encoding import CHARSETS, Encoding, binary_width, register_charset, sign_readings
from mainspring.operators.records import RecordFormat, decode_records, encode_records
from mainspring.plans.layout import Dialect

LENIENT = {s: Dialect(s, "ignored", "lenient", 4, 8) for s in ("2-4-8", "1-2-4-8", "1--8", "full")}


def fmt(clause, sign="zone37", charset="ascii", order="big", floats="ieee", size="2-4-8", trunc="std"):
    return RecordFormat.of(f"01 R. 05 V {clause}.", LENIENT[size], Encoding(charset, sign, order, floats, size), trunc)


def read(spark, f, h, mode="PERMISSIVE"):
    frame = spark.createDataFrame([(bytearray.fromhex(h.replace(" ", "")),)], "value binary")
    return decode_records(frame, f, mode=mode).first()


def write(spark, f, value, kind):
    return encode_records(spark.createDataFrame([(value,)], f"V {kind}"), f).select(F.hex("value")).first()[0]


VALUES = [
    ("PIC S9(5)", dict(sign="ebcdic", charset="cp037"), 12345, "F1F2F3F4C5"),
    ("PIC S9(5)", dict(sign="ebcdic", charset="cp037"), -12345, "F1F2F3F4D5"),
    ("PIC S9(5)", {}, 12345, "3132333435"),
    ("PIC S9(5)", {}, -12345, "3132333475"),
    ("PIC S9(5)", dict(sign="translated"), 12345, "3132333445"),
    ("PIC S9(5)", dict(sign="translated"), -12345, "313233344E"),
    ("PIC S9(5)", dict(sign="realia"), 12345, "3132333435"),
    ("PIC S9(5)", dict(sign="realia"), -12345, "3132333425"),
    ("PIC 9(5)", dict(sign="ebcdic", charset="cp037"), 12345, "F1F2F3F4F5"),
    ("PIC 9(5)", {}, 12345, "3132333435"),
    ("PIC S9(5) SIGN LEADING SEPARATE", {}, -12345, "2D3132333435"),
    ("PIC S9(5) SIGN LEADING SEPARATE", dict(sign="ebcdic", charset="cp037"), -12345, "60F1F2F3F4F5"),
    ("PIC S9(5) SIGN TRAILING SEPARATE", {}, 12345, "31323334352B"),
    ("PIC S9(5) SIGN TRAILING SEPARATE", dict(sign="ebcdic", charset="cp037"), 12345, "F1F2F3F4F54E"),
    ("PIC S9(5) SIGN LEADING", dict(sign="ebcdic", charset="cp037"), -12345, "D1F2F3F4F5"),
    ("PIC S9(5) COMP-3", {}, 12345, "12345C"),
    ("PIC S9(5) COMP-3", {}, -12345, "12345D"),
    ("PIC 9(5) COMP-3", {}, 12345, "12345F"),
    ("PIC S9(4) COMP-3", {}, -1234, "01234D"),
    ("PIC S9(4) COMP-3", {}, 1234, "01234C"),
    ("PIC 9(4) COMP-6", {}, 1234, "1234"),
    ("PIC 9(3) COMP-6", {}, 123, "0123"),
    ("PIC S9(4) COMP", {}, 1234, "04D2"),
    ("PIC S9(4) COMP", {}, -1234, "FB2E"),
    ("PIC S9(4) COMP", dict(order="little"), -1234, "2EFB"),
    ("PIC S9(9) COMP", {}, 123456789, "075BCD15"),
    ("PIC S9(9) COMP", dict(order="little"), 123456789, "15CD5B07"),
    ("PIC 9(4) COMP-5", {}, 65535, "FFFF"),
    ("PIC S9(31) COMP", {}, -(10**30) - 7, f"{(1 << 128) - 10**30 - 7:032X}"),
    ("PIC 9(18) COMP-5", {}, (1 << 64) - 1, "F" * 16),
    ("PIC S9(5)PP COMP-3", {}, 1234500, "12345C"),
    ("PIC SPPP99", {}, "0.00012", "3132"),
    ("COMP-1", {}, 1.0, "3F800000"),
    ("COMP-1", dict(order="little"), 1.0, "0000803F"),
    ("COMP-1", dict(floats="hfp"), 1.0, "41100000"),
    ("COMP-2", {}, 1.0, "3FF0000000000000"),
    ("COMP-2", dict(floats="hfp"), 1.0, "4110000000000000"),
    ("COMP-2", dict(floats="hfp"), -118.625, "C276A00000000000"),
]


@pytest.mark.parametrize(("clause", "options", "value", "h"), VALUES)
def test_both_ways(spark, clause, options, value, h):
    f = fmt(clause, **options)
    row = read(spark, f, h)
    assert str(float(row.V)) == str(float(value)) and row._faults == []
    kind = "double" if "COMP-1" in clause or "COMP-2" in clause else "decimal(38,5)" if "P" in clause.split("PIC")[-1].split()[0] else "decimal(38,0)"
    from decimal import Decimal

    assert write(spark, f, value if kind == "double" else Decimal(value), kind) == h


FAULTS = [
    ("PIC S9(5)", {}, "313233347B", 4, "zoned_sign", "7B"),
    ("PIC S9(5)", dict(sign="translated"), "3132333475", 4, "zoned_sign", "75"),
    ("PIC S9(5)", {}, "3132333425", 4, "zoned_sign", "25"),
    ("PIC S9(5)", {}, "F1F2F3F4D5", 0, "zoned_digit", "F1"),
    ("PIC S9(5)", dict(sign="ebcdic", charset="cp037"), "3132333435", 0, "zoned_digit", "31"),
    ("PIC S9(5) SIGN TRAILING SEPARATE", {}, "41323334352A", 5, "zoned_separate_sign", "2A"),
    ("PIC S9(5) SIGN LEADING", {}, "4132333445", 0, "zoned_sign", "41"),
    ("PIC S9(5) COMP-3", {}, "123455", 2, "packed_sign", "55"),
    ("PIC S9(5) COMP-3", {}, "1A345C", 0, "packed_digit", "1A"),
    ("PIC S9(4) COMP-3", {}, "F2345C", 0, "packed_pad", "F2"),
    ("PIC S9(4) COMP-3", {}, "FA3A51", 0, "packed_pad", "FA"),
    ("PIC S9(4) COMP-3", {}, "023A51", 1, "packed_digit", "3A"),
    ("PIC 9(4) COMP-6", {}, "123C", 1, "packed_digit", "3C"),
    ("PIC 9(3) COMP-6", {}, "F123", 0, "packed_pad", "F1"),
    ("PIC S9(4) COMP", {}, "7FFF", 0, "binary_range", "7F"),
    ("PIC S9(4) COMP", {}, "04", 1, "short_record", None),
    ("COMP-1", dict(floats="hfp"), "7FFFFFFF", 0, "float_range", "7F"),
]


@pytest.mark.parametrize(("clause", "options", "h", "offset", "kind", "byte"), FAULTS)
def test_first_fault(spark, clause, options, h, offset, kind, byte):
    row = read(spark, fmt(clause, **options), h)
    assert row.V is None
    assert [tuple(x) for x in row._faults] == [("V", offset, kind, byte)]
    with pytest.raises(PySparkException, match="V"):
        read(spark, fmt(clause, **options), h, "FAILFAST")
    assert read(spark, fmt(clause, **options), h, "DROPMALFORMED") is None


@pytest.mark.parametrize(("h", "value"), [("12345A", 12345), ("12345E", 12345), ("12345B", -12345), ("12345F", 12345)])
def test_packed_signs_are_read_leniently(spark, h, value):
    assert read(spark, fmt("PIC S9(5) COMP-3"), h).V == value


@pytest.mark.parametrize(("h", "value"), [("F1A2", 12), ("F1E2", 12), ("F1B2", -12), ("F1F2", 12)])
def test_zoned_signs_are_read_leniently(spark, h, value):
    assert read(spark, fmt("PIC S99", sign="ebcdic", charset="cp037"), h).V == value


@pytest.mark.parametrize(("clause", "value"), [("PIC 9(3)", 1000), ("PIC 9(3)", -1), ("PIC S9(3) COMP-3", 1000), ("PIC 9(3) COMP-3", -1), ("PIC 9(4) COMP-6", -1), ("PIC S9(4) COMP", 10000), ("PIC 9(4) COMP", -1), ("PIC S9(4) COMP-5", 32768), ("PIC 9(4) COMP-5", 65536)])
def test_numbers_that_do_not_fit(spark, clause, value):
    with pytest.raises(PySparkException, match="fit"):
        write(spark, fmt(clause), value, "long")


def test_text(spark):
    f = fmt("PIC X(4)", sign="ebcdic", charset="cp037")
    assert write(spark, f, "Aé", "string") == "C1514040" and read(spark, f, "C1514040").V == "Aé"
    right = fmt("PIC X(4) JUSTIFIED RIGHT")
    assert write(spark, right, "ab", "string") == "20206162" and read(spark, right, "20206162").V == "ab"
    assert read(spark, fmt("PIC X(3)"), "202020").V == ""
    for bad in ("abcde", "日本"):
        with pytest.raises(PySparkException, match="too long or"):
            write(spark, f, bad, "string")


@pytest.mark.parametrize("charset", ["ascii", "cp037"])
def test_all_bytes_of_a_charset(spark, charset):
    f = fmt("PIC X(256)", sign="ebcdic", charset=charset)
    got = read(spark, f, bytes(range(256)).hex()).V
    assert got == CHARSETS[charset].unicode and write(spark, f, got, "string") == bytes(range(256)).hex().upper()


def test_conventions_reject_each_others_negatives():
    for a in ("ebcdic", "zone37", "translated", "realia"):
        for b in ("ebcdic", "zone37", "translated", "realia"):
            if a != b:
                assert not {x for x, (_, n) in sign_readings(a).items() if n} & set(sign_readings(b))


@pytest.mark.parametrize(("size", "widths"), [("2-4-8", "22224444488888888816"), ("1-2-4-8", "11224444488888888816"), ("1--8", "11223344455666778816"), ("full", "88888888888888888816")])
def test_staircases(size, widths):
    assert "".join(str(binary_width(d, size)) for d in range(1, 20)) == widths


def test_facts_must_be_stated():
    for bad in (Encoding("", "ebcdic", "big", "hfp", "2-4-8"), Encoding("cp037", "", "big", "hfp", "2-4-8"), Encoding("cp037", "ebcdic", "", "hfp", "2-4-8"), Encoding("cp037", "ebcdic", "big", "", "2-4-8"), Encoding("cp037", "ebcdic", "big", "hfp", "")):
        with pytest.raises(errors.EncodingError):
            bad.validate()
    with pytest.raises(errors.EncodingError):
        RecordFormat.of("01 R PIC X.", "gnucobol", "ibm", "std")
    with pytest.raises(errors.EncodingError):
        RecordFormat.of("01 R PIC X.", "ibm", "ibm", "")
    with pytest.raises(errors.EncodingError):
        register_charset("short", "abc")


MIXED = "01 TXN. 05 ID PIC X(4). 05 AMT PIC S9(5) COMP-3. 05 QTY PIC S9(4) COMP. 05 NAME PIC X(6)."


@pytest.mark.parametrize(("dialect", "encoding", "h"), [("ibm", "ibm", "C1F1F2F312345D04D2E6C9C4C7C5E3"), ("microfocus", "microfocus", "4131323312345DD204574944474554"), ("ibm", "converted", "4131323312345D04D2574944474554")])
def test_mixed_record(spark, dialect, encoding, h):
    f = RecordFormat.of(MIXED, dialect, encoding, "std")
    frame = spark.createDataFrame([(bytearray.fromhex(h),)], "value binary")
    out = decode_records(frame, f)
    assert tuple(out.first()) == ("A123", -12345, 1234, "WIDGET")
    assert encode_records(out, f).select(F.hex("value")).first()[0] == h


def test_unread_items_are_pruned(spark):
    f = RecordFormat.of(MIXED, "ibm", "ibm", "std")
    frame = spark.createDataFrame([(bytearray(15),)], "value binary")
    plan = decode_records(frame, f).select("ID")._jdf.queryExecution().optimizedPlan().toString()
    assert "conv" not in plan and "decimal" not in plan
