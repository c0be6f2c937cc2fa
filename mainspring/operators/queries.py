"""The record operators as queries over the star schema, each with its SQL.

Columns of the tables are encoded to record bytes, whose hex is held against a formula in SQL,
or decoded again and held against the column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import picture
from ..functions.encoding import SIGN_TABLES, STAIRCASES, Encoding
from ..plans import copybook, lexer
from ..plans.layout import DIALECTS, Dialect, lay_out
from . import source
from .records import RecordFormat, decode_records, encode_records, fault_column

CENTS = "CAST(round(%s * 100) AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def fmt(source: str, kind: str = "ibm", trunc: str = "std", **options) -> RecordFormat:
    return RecordFormat.of(source, {"converted": "ibm"}.get(kind, kind), kind, trunc, **options)


CUSTOMER = """
01 CUSTOMER-RECORD.
   05 CUST-KEY PIC 9(9) COMP.
   05 CUST-NAME PIC X(25).
   05 CUST-NATION PIC 9(4) COMP-6.
   05 CUST-BALANCE PIC S9(11)V99 COMP-3.
   05 CUST-SEGMENT PIC X(12).
"""


def _ibm_customers() -> RecordFormat:
    return RecordFormat.of(CUSTOMER, "ibm", "ibm", "std")


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = c.select(F.col("c_custkey").alias("CUST-KEY"), F.col("c_name").alias("CUST-NAME"), F.col("c_nationkey").alias("CUST-NATION"), (cents("c_acctbal").cast("decimal(15,0)") / 100).cast("decimal(15,2)").alias("CUST-BALANCE"), F.col("c_mktsegment").alias("CUST-SEGMENT"))
    return encode_records(own, _ibm_customers())


def record_decode_agg(spark, sf_dir):
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers())
    return own.groupBy(F.col("CUST-NATION").cast("long").alias("nation")).agg(F.count("*").alias("customers"), (F.sum("CUST-BALANCE") * 100).cast("long").alias("balance_cents"))


def record_filter_project(spark, sf_dir):
    """A filter and two of five items: the others are not decoded."""
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers())
    return own.where(F.col("CUST-SEGMENT") == "BUILDING").select(F.col("CUST-KEY").cast("long").alias("custkey"), F.col("CUST-NAME").alias("name"))


def record_join(spark, sf_dir):
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers())
    nations = table(spark, sf_dir, "nation")
    joined = own.join(nations, own["CUST-NATION"].cast("int") == nations["n_nationkey"])
    return joined.groupBy("n_name").agg(F.max(F.col("CUST-BALANCE") * 100).cast("long").alias("most_cents"))


def packed_encode(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", cents("c_acctbal").alias("V"))
    return encode_records(own, fmt("01 R. 05 V PIC S9(9) COMP-3."), ("c_custkey",)).select("c_custkey", F.hex("value").alias("bytes"))


def packed_unsigned_even(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("V"))
    return encode_records(own, fmt("01 R. 05 V PIC 9(4) COMP-3."), ("p_partkey",)).select("p_partkey", F.hex("value").alias("bytes"))


def packed_roundtrip(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", (cents("c_acctbal").cast("decimal(15,0)") / 100).cast("decimal(9,2)").alias("V"))
    f = fmt("01 R. 05 V PIC S9(7)V99 COMP-3.")
    return decode_records(encode_records(own, f, ("c_custkey",)), f, keep=("c_custkey",)).select("c_custkey", (F.col("V") * 100).cast("long").alias("cents"))


def comp6_encode(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("V"))
    return encode_records(own, fmt("01 R. 05 V PIC 9(7) COMP-6."), ("o_orderkey",)).select("o_orderkey", F.hex("value").alias("bytes"))


def comp6_roundtrip(spark, sf_dir):
    own, f = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("V")), fmt("01 R. 05 V PIC 9(8) COMP-6.")
    return decode_records(encode_records(own, f, ("o_orderkey",)), f, keep=("o_orderkey",)).select("o_orderkey", F.col("V").cast("long").alias("custkey"))


ZONED = """
01 R.
   05 T PIC S9(8).
   05 L PIC S9(8) SIGN LEADING.
   05 TS PIC S9(8) SIGN TRAILING SEPARATE.
   05 LS PIC S9(8) SIGN IS LEADING SEPARATE CHARACTER.
   05 U PIC 9(8).
"""
_ZONED_ENCODINGS = {
    "ebcdic": Encoding("cp037", "ebcdic", "big", "hfp", "2-4-8"),
    "zone37": Encoding("ascii", "zone37", "big", "ieee", "2-4-8"),
    "translated": Encoding("ascii", "translated", "big", "hfp", "2-4-8"),
    "realia": Encoding("ascii", "realia", "big", "ieee", "2-4-8"),
}


def _zoned(sign):
    f = RecordFormat.of(ZONED, DIALECTS["ibm"], _ZONED_ENCODINGS[sign], "std")

    def bytes_(spark, sf_dir):
        v = cents("c_acctbal")
        own = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n in ("T", "L", "TS", "LS")], F.abs(v).alias("U"))
        h = F.hex("value")
        return encode_records(own, f, ("c_custkey",)).select("c_custkey", F.substring(h, 1, 16).alias("t"), F.substring(h, 17, 16).alias("l"), F.substring(h, 33, 18).alias("ts"), F.substring(h, 51, 18).alias("ls"), F.substring(h, 69, 16).alias("u"))

    def back(spark, sf_dir):
        v = cents("c_acctbal")
        own = table(spark, sf_dir, "customer").select("c_custkey", *[v.alias(n) for n in ("T", "L", "TS", "LS")], F.abs(v).alias("U"))
        out = decode_records(encode_records(own, f, ("c_custkey",)), f, keep=("c_custkey",))
        return out.select("c_custkey", *[F.col(n).cast("long").alias(n.lower()) for n in ("T", "L", "TS", "LS", "U")])

    return bytes_, back


def _zoned_sql(sign):
    own = SIGN_TABLES[sign]
    digit, plus, minus = ("F", "4E", "60") if sign == "ebcdic" else ("3", "2B", "2D")
    marked = lambda d: f"CASE WHEN v < 0 THEN CASE {d} " + " ".join(f"WHEN '{k}' THEN '{b:02X}'" for k, b in enumerate(own["negative"])) + f" END ELSE CASE {d} " + " ".join(f"WHEN '{k}' THEN '{b:02X}'" for k, b in enumerate(own["positive"])) + " END END"
    plain = lambda s: f"regexp_replace({s}, '(.)', '{digit}\\1', 'g')"
    mark = f"CASE WHEN v < 0 THEN '{minus}' ELSE '{plus}' END"
    return f"""
    WITH o AS (SELECT c_custkey, {CENTS % 'c_acctbal'} AS v FROM customer),
    d AS (SELECT c_custkey, v, lpad(CAST(abs(v) AS VARCHAR), 8, '0') AS s FROM o)
    SELECT c_custkey, {plain("s[1:7]")} || {marked("s[8:8]")} AS t, {marked("s[1:1]")} || {plain("s[2:8]")} AS l,
      {plain("s")} || {mark} AS ts, {mark} || {plain("s")} AS ls, {plain("s")} AS u FROM d"""


BINARY = """
01 R.
   05 A PIC S9(2) COMP.
   05 B PIC S9(4) COMP.
   05 C PIC S9(6) COMP.
   05 D PIC S9(9) COMP.
   05 E PIC S9(11) COMP.
   05 F PIC S9(14) COMP.
   05 G PIC S9(16) COMP.
   05 H PIC S9(18) COMP.
   05 I PIC S9(31) COMP.
   05 J PIC 9(18) COMP-5.
"""
_DIGITS = (("A", 2), ("B", 4), ("C", 6), ("D", 9), ("E", 11), ("F", 14), ("G", 16), ("H", 18), ("I", 31))


def _binary(staircase, order):
    dialect, encoding = Dialect(staircase, "ignored", "lenient", 4, 8), Encoding("ascii", "zone37", order, "ieee", staircase)
    f = RecordFormat.of(BINARY, dialect, encoding, "std")

    def values(spark, sf_dir):
        v = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
        return table(spark, sf_dir, "orders").select("o_orderkey", *[(v % (100 if d == 2 else 10000 if d == 4 else 1000000)).alias(n) if d < 9 else v.alias(n) for n, d in _DIGITS], F.col("o_orderkey").alias("J"))

    def bytes_(spark, sf_dir):
        return encode_records(values(spark, sf_dir), f, ("o_orderkey",)).select("o_orderkey", F.hex("value").alias("bytes"))

    def back(spark, sf_dir):
        out = decode_records(encode_records(values(spark, sf_dir), f, ("o_orderkey",)), f, keep=("o_orderkey",))
        return out.select("o_orderkey", *[F.col(n).cast("long").alias(n.lower()) for n, _ in _DIGITS], F.col("J").cast("long").alias("j"))

    return bytes_, back


def _binary_values_sql():
    own = [f"v % {100 if d == 2 else 10000 if d == 4 else 1000000} AS {n.lower()}" if d < 9 else f"v AS {n.lower()}" for n, d in _DIGITS]
    return f"SELECT o_orderkey, {', '.join(own)}, o_orderkey AS j FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE o_orderkey END AS v FROM orders)"


def _binary_sql(staircase, order):
    def part(name, digits):
        width = next((w for most, w in STAIRCASES[staircase] if digits <= most), 16)
        full = f"lpad(hex({name}), 16, '0')"
        h = f"right({full}, {2 * width})" if width <= 8 else f"(CASE WHEN {name} < 0 THEN repeat('F', 16) ELSE repeat('0', 16) END || {full})"
        return h if order == "big" else " || ".join(f"({h})[{2 * k + 1}:{2 * k + 2}]" for k in reversed(range(width)))

    return f"SELECT o_orderkey, {' || '.join(part(n.lower(), d) for n, d in _DIGITS)} || {part('j', 18)} AS bytes FROM ({_binary_values_sql()})"


def comp5_full_range(spark, sf_dir):
    """COMP-5 holds what its bytes hold, beyond the digits of its picture."""
    f = fmt("01 R. 05 V PIC 9(4) COMP-5. 05 W PIC S9(4) COMP-5.")
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 65536).alias("V"), (F.col("o_orderkey") % 32768 - 16384).alias("W"))
    return decode_records(encode_records(own, f, ("o_orderkey",)), f, keep=("o_orderkey",)).select("o_orderkey", F.col("V").cast("long").alias("v"), F.col("W").cast("long").alias("w"))


def _float(kind):
    def run(spark, sf_dir):
        f = fmt("01 R. 05 Q COMP-1. 05 P COMP-2. 05 D COMP-2.", kind)
        own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("Q"), cents("l_extendedprice").cast("double").alias("P"), F.col("l_discount").alias("D"))
        out = decode_records(encode_records(own, f, ("l_orderkey", "l_linenumber")), f, keep=("l_orderkey", "l_linenumber"))
        return out.select("l_orderkey", "l_linenumber", F.col("Q").cast("double").alias("quantity"), F.col("P").alias("cents"), F.round(F.col("D"), 6).alias("discount"))

    return run


FLOAT_SQL = f"SELECT l_orderkey, l_linenumber, l_quantity AS quantity, CAST({CENTS % 'l_extendedprice'} AS DOUBLE) AS cents, round(l_discount, 6) AS discount FROM lineitem"


def alnum_cp037(spark, sf_dir):
    f = fmt("01 R. 05 N PIC X(40). 05 J PIC X(40) JUSTIFIED RIGHT.")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("N"), F.col("c_mktsegment").alias("J"))
    return decode_records(encode_records(own, f, ("c_custkey",)), f, keep=("c_custkey",)).select("c_custkey", F.col("N").alias("name"), F.col("J").alias("segment"))


def alnum_cp037_bytes(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("N"))
    return encode_records(own, fmt("01 R. 05 N PIC X(10)."), ("o_orderkey",)).select("o_orderkey", F.hex("value").alias("bytes"))


ORDER = """
01 ORDER-RECORD.
   05 LINE-COUNT PIC 9(2).
   05 LINES OCCURS %s.
      10 LINE-NUMBER PIC 9(4) COMP.
      10 PART PIC 9(9) COMP-3.
      10 QUANTITY PIC 9(5).
   05 ORDER-KEY PIC 9(12) COMP-3.
"""


def _occurs(clause):
    def run(spark, sf_dir):
        """Every line of every order: an order of more than seven lines takes several records."""
        f = fmt(ORDER % clause)
        own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ORDER-KEY"), F.struct(F.col("l_linenumber").alias("LINE-NUMBER"), F.col("l_partkey").alias("PART"), F.col("l_quantity").cast("int").alias("QUANTITY")).alias("line"))
        place = F.row_number().over(Window.partitionBy("ORDER-KEY").orderBy("line"))
        own = own.withColumn("record", F.floor((place - 1) / 7)).groupBy("ORDER-KEY", "record").agg(F.array_sort(F.collect_list("line")).alias("LINES"))
        own = own.drop("record").withColumn("LINE-COUNT", F.size("LINES"))
        out = decode_records(encode_records(own, f), f)
        flat = out.select(F.col("ORDER-KEY").cast("long").alias("orderkey"), F.col("LINE-COUNT").cast("int").alias("n"), F.posexplode_outer("LINES").alias("k", "x"))
        return flat.where("k < n").select("orderkey", F.col("x.LINE-NUMBER").cast("long").alias("linenumber"), F.col("x.PART").cast("long").alias("partkey"), F.col("x.QUANTITY").cast("long").alias("quantity"))

    return run


OCCURS_SQL = """
SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_partkey AS partkey, CAST(floor(l_quantity) AS BIGINT) AS quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, floor(l_quantity)) AS k FROM lineitem WHERE l_linenumber <= 7)
WHERE k <= 7"""

MIXED = """
01 PARTY.
   05 KIND PIC X.
   05 KEY-NO PIC 9(9) COMP.
   05 BODY PIC X(20).
   05 MONEY REDEFINES BODY.
      10 BALANCE PIC S9(9)V99 COMP-3.
      10 FILLER PIC X(14).
"""


def redefines_union(spark, sf_dir):
    """Two kinds of record over the same bytes: text in one, an amount in the other."""
    f = fmt(MIXED)
    text = fmt(MIXED)
    people = encode_records(table(spark, sf_dir, "customer").select(F.lit("C").alias("KIND"), F.col("c_custkey").alias("KEY-NO"), F.col("c_name").alias("BODY")), text)
    money = fmt("01 PARTY. 05 KIND PIC X. 05 KEY-NO PIC 9(9) COMP. 05 BALANCE PIC S9(9)V99 COMP-3. 05 REST PIC X(14).")
    firms = encode_records(table(spark, sf_dir, "supplier").select(F.lit("S").alias("KIND"), F.col("s_suppkey").alias("KEY-NO"), (cents("s_acctbal").cast("decimal(12,0)") / 100).cast("decimal(11,2)").alias("BALANCE")), money)
    out = decode_records(people.union(firms), f, mode="PERMISSIVE")
    return out.select(F.col("KIND").alias("kind"), F.col("KEY-NO").cast("long").alias("id"), F.when(F.col("KIND") == "C", F.col("BODY")).alias("name"), F.when(F.col("KIND") == "S", (F.col("MONEY.BALANCE") * 100).cast("long")).alias("cents"))


SEGMENTS = """
01 R.
   05 CUST-KEY PIC 9(9) COMP-3.
   05 SEGMENT PIC X(12).
      88 BUILDS VALUE 'BUILDING'.
      88 MOVES VALUES 'AUTOMOBILE' 'MACHINERY'.
   05 BALANCE PIC S9(7) COMP-3.
      88 OWES VALUE -9999999 THRU -1.
      88 EVEN-HANDED VALUE ZERO.
66 KEY-AND-SEGMENT RENAMES CUST-KEY THRU SEGMENT.
"""


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = fmt(SEGMENTS)
    own = c.select(F.col("c_custkey").alias("CUST-KEY"), F.col("c_mktsegment").alias("SEGMENT"), F.floor("c_acctbal").alias("BALANCE"))
    return decode_records(encode_records(own, f), f, conditions=True, aliases=True)


def level88(spark, sf_dir):
    return _segments(spark, sf_dir).select(F.col("CUST-KEY").cast("long").alias("custkey"), F.col("BUILDS").alias("builds"), F.col("MOVES").alias("moves"), F.col("OWES").alias("owes"))


LETTERS = """
01 LETTERS.
   05 CUST-KEY PIC 9(9) COMP.
   05 LETTER PIC X OCCURS %d.
      88 VOWEL VALUE 'A' 'E' 'I' 'O' 'U'.
      88 EARLY VALUE 'A' THRU 'I'.
"""


def level88_in_tables(spark, sf_dir):
    """Conditions of a table's items: an array of booleans each, as many as the longest segment has letters."""
    c = table(spark, sf_dir, "customer")
    f = fmt(LETTERS % (c.agg(F.max(F.length("c_mktsegment"))).first()[0] or 1))
    own = c.select(F.col("c_custkey").alias("CUST-KEY"), F.split("c_mktsegment", "").alias("LETTER"))
    out = decode_records(encode_records(own, f), f, conditions=True)
    held = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return out.select(F.col("CUST-KEY").cast("long").alias("custkey"), held("VOWEL").alias("vowels"), held("EARLY").alias("early"))


def integral_types(spark, sf_dir):
    """Whole numbers as int and long columns, added up without decimals."""
    o, f = table(spark, sf_dir, "orders"), fmt("01 R. 05 ORDER-KEY PIC 9(12) COMP-3. 05 CUST-KEY PIC 9(9) COMP. 05 PRICE PIC S9(11) COMP-3.", integral=True)
    own = o.select(F.col("o_orderkey").alias("ORDER-KEY"), F.col("o_custkey").alias("CUST-KEY"), cents("o_totalprice").alias("PRICE"))
    out = decode_records(encode_records(own, f), f)
    return out.groupBy(F.col("CUST-KEY").cast("long").alias("custkey")).agg(F.sum("PRICE").alias("price"), F.max("ORDER-KEY").alias("last_order"))


def renames(spark, sf_dir):
    return _segments(spark, sf_dir).select(F.col("CUST-KEY").cast("long").alias("custkey"), F.hex(F.substring("KEY-AND-SEGMENT", 1, 5)).alias("key_bytes"), F.length("KEY-AND-SEGMENT").cast("long").alias("bytes"))


def fault_report(spark, sf_dir):
    """Every seventh record loses a digit, every eleventh its sign; all faults are listed."""
    f = fmt("01 R. 05 K PIC 9(9) COMP-3. 05 V PIC S9(9) COMP-3.")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("K"), cents("c_acctbal").alias("V"), "c_custkey")
    raw = encode_records(own, f, ("c_custkey",))
    h = F.hex("value")
    h = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.substring(h, 1, 12), F.lit("B"), F.substring(h, 14, 7))).otherwise(h)
    h = F.when(F.col("c_custkey") % 11 == 0, F.concat(F.substring(h, 1, 19), F.lit("3"))).otherwise(h)
    bad = raw.select("c_custkey", F.unhex(h).alias("value"))
    out = bad.select("c_custkey", F.explode(fault_column(f, F.col("value"))).alias("x"))
    return out.select("c_custkey", F.col("x.field").alias("field"), F.col("x.offset").cast("long").alias("at"), F.col("x.kind").alias("kind"))


def drop_malformed(spark, sf_dir):
    f = fmt("01 R. 05 K PIC 9(9) COMP-3.")
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("K"), "c_custkey")
    raw = encode_records(own, f, ("c_custkey",)).select(F.when(F.col("c_custkey") % 3 == 0, F.substring("value", 1, F.lit(4))).otherwise(F.col("value")).alias("value"))
    return decode_records(raw, f, mode="DROPMALFORMED").select(F.col("K").cast("long").alias("custkey"))




def picture_info(spark, sf_dir):
    rows = [(p.source, p.category, p.digits, p.scale, p.signed, p.size) for p in map(picture.parse, ("9(5)", "S9(3)V9(2)", "V9(5)", "9(5)PPP", "PPP9(5)", "SPPP99", "A(4)", "ZZ,ZZ9.99", "9(3)V99", "9(5)P"))]
    return spark.createDataFrame(rows, "source string, category string, digits int, scale int, signed boolean, size int")


PICTURE_SQL = """SELECT * FROM (VALUES ('9(5)','numeric',5,0,false,5),('S9(3)V9(2)','numeric',5,2,true,5),('V9(5)','numeric',5,5,false,5),
('9(5)PPP','numeric',5,-3,false,5),('PPP9(5)','numeric',5,8,false,5),('SPPP99','numeric',2,5,true,2),('A(4)','alphabetic',0,0,false,4),
('ZZ,ZZ9.99','numeric-edited',7,2,false,9),('9(3)V99','numeric',5,2,false,5),('9(5)P','numeric',5,-1,false,5)) t(source,category,digits,scale,signed,size)"""

PARCEL = """
01 PARCEL.
   05 PARCEL-NO PIC 9(7).
   05 ZONE PIC X(2).
   05 FEE PIC S9(7)V99 COMP-3.
   05 LEGS PIC S9(6) COMP.
   05 DEST PIC X(18).
   05 DEPOT REDEFINES DEST.
      10 DEPOT-CODE PIC X(10).
      10 BAY PIC 9(3) COMP.
      10 FILLER PIC X(6).
   05 STOPS OCCURS 3 TIMES.
      10 STOP-CODE PIC X(4).
      10 DWELL PIC S9(3) COMP-3.
"""


def layout_items(spark, sf_dir):
    rows = [(i["name"], i["offset"], i["length"], i["occurs"]) for i in lay_out(copybook.records(PARCEL)[0], DIALECTS["ibm"]).rows()]
    return spark.createDataFrame(rows, "name string, start int, length int, occurs int")


LAYOUT_SQL = """SELECT * FROM (VALUES ('PARCEL',0,54,1),('PARCEL-NO',0,7,1),('ZONE',7,2,1),('FEE',9,5,1),('LEGS',14,4,1),('DEST',18,18,1),
('DEPOT',18,18,1),('DEPOT-CODE',18,10,1),('BAY',28,2,1),('FILLER',30,6,1),('STOPS',36,6,3),('STOP-CODE',36,4,1),('DWELL',40,2,1)) t(name,start,length,occurs)"""


def tokens(spark, sf_dir):
    source = "01 A PIC S9(4)V99. *> note\n   05 B VALUE 'x y'."
    rows = [(t.line, t.column, t.type, t.value) for t in lexer.tokenize(source)]
    return spark.createDataFrame(rows, "line int, col int, type string, value string")


TOKENS_SQL = """SELECT * FROM (VALUES (1,1,'Number','01'),(1,4,'Identifier','A'),(1,6,'Identifier','PIC'),(1,10,'Picture','S9(4)V99'),(1,18,'Symbol','.'),
(1,20,'Comment','*> note'),(2,4,'Number','05'),(2,7,'Identifier','B'),(2,9,'Identifier','VALUE'),(2,15,'String','''x y'''),(2,20,'Symbol','.')) t(line,col,type,value)"""


def record_window(spark, sf_dir):
    """The three largest balances of each nation, ties to the smaller key."""
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers())
    order = Window.partitionBy("CUST-NATION").orderBy(F.desc("CUST-BALANCE"), "CUST-KEY")
    top = own.withColumn("place", F.row_number().over(order)).where("place <= 3")
    return top.select(F.col("CUST-NATION").cast("long").alias("nation"), F.col("place").cast("long").alias("place"), F.col("CUST-KEY").cast("long").alias("custkey"))


def record_rollup(spark, sf_dir):
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers())
    return own.rollup(F.col("CUST-NATION").cast("long").alias("nation"), F.col("CUST-SEGMENT").alias("segment")).agg((F.sum("CUST-BALANCE") * 100).cast("long").alias("cents"))


def record_anti_join(spark, sf_dir):
    """Customers without an order whose key is divisible by 40."""
    own = decode_records(customer_records(spark, sf_dir), _ibm_customers()).select(F.col("CUST-KEY").cast("long").alias("custkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select("o_custkey")
    return own.join(orders, own["custkey"] == orders["o_custkey"], "left_anti")


def sync_layout(spark, sf_dir):
    text = "01 R. 05 A PIC X. 05 B PIC 9(9) COMP SYNC. 05 C OCCURS 2. 10 D PIC X. 10 E PIC 9(4) COMP SYNC. 05 F COMP-2 SYNC."
    rows = [(i["name"], i["offset"], i["length"], i["slack"]) for i in lay_out(copybook.records(text)[0], DIALECTS["ibm"]).rows()]
    return spark.createDataFrame(rows, "name string, start int, length int, slack int")


def odo_layout(spark, sf_dir):
    """Where the item after a DEPENDING ON table starts, for each count."""
    own = lay_out(copybook.records("01 R. 05 N PIC 9(2). 05 A PIC X(3) OCCURS 1 TO 5 DEPENDING ON N. 05 TAIL PIC X(4).")[0], DIALECTS["ibm"])
    return spark.createDataFrame([(n, own.rows({"A": n})[-1]["offset"], own.rows({"A": n})[0]["length"]) for n in range(1, 6)], "n int, tail int, length int")


PROGRAMS = (
    ("a.cob", "IDENTIFICATION DIVISION. PROGRAM-ID. A. PROCEDURE DIVISION. M. CALL 'B' USING X. IF X = 1 CALL 'C' ELSE DISPLAY X. PERFORM M 2 TIMES. STOP RUN."),
    ("b.cob", "IDENTIFICATION DIVISION. PROGRAM-ID. B. PROCEDURE DIVISION. M. COMPUTE A = B + C * 2. CALL 'C'. CALL 'C'. GOBACK."),
    ("bad.cob", "IDENTIFICATION DIVISION. PROGRAM-ID. B. PROCEDURE DIVISION. M. MOVE."),
)


def _programs(spark):
    return spark.createDataFrame([p for p in PROGRAMS if p[0] != "bad.cob"], "path string, content string")


def ast_verb_counts(spark, sf_dir):
    return source.verb_counts(source.ast_nodes(_programs(spark)))


def ast_call_graph(spark, sf_dir):
    return source.call_graph(source.ast_nodes(_programs(spark)))


def ast_expression(spark, sf_dir):
    """Operators of an expression and the operators right below them, by the tree's parent links."""
    nodes = source.ast_nodes(_programs(spark)).where("kind = 'BinaryExpr'")
    top = nodes.select("path", "node_id", F.col("attrs")["op"].alias("outer_op"))
    sub = nodes.select(F.col("path").alias("p"), F.col("parent_id").alias("up"), F.col("attrs")["op"].alias("inner_op"))
    return top.join(sub, (F.col("path") == F.col("p")) & (F.col("node_id") == F.col("up"))).select("path", "outer_op", "inner_op")


def source_printed(spark, sf_dir):
    one = spark.createDataFrame([("x", "identification division. program-id. a. procedure division. m. if a > 1 display 'b' end-if.")], "path string, content string")
    return source.printed(one).select("text")


def source_errors(spark, sf_dir):
    return source.parse_errors(spark.createDataFrame(PROGRAMS, "path string, content string")).select("path", "kind")


def copybook_entry_rows(spark, sf_dir):
    one = spark.createDataFrame([("c", "01 R. 05 A PIC 9(4) COMP-3. 05 FILLER PIC X OCCURS 2 TO 5 DEPENDING ON A. 05 B REDEFINES A PIC X(3).")], "path string, content string")
    return source.copybook_entries(one).drop("path", "line")


def _both() -> tuple[dict, dict]:
    own = {f.__name__: f for f in (record_decode_agg, record_filter_project, record_join, packed_encode, packed_unsigned_even, packed_roundtrip, comp6_encode, comp6_roundtrip, comp5_full_range, alnum_cp037, alnum_cp037_bytes, redefines_union, level88, level88_in_tables, integral_types, renames, fault_report, drop_malformed, picture_info, layout_items, tokens, record_window, record_rollup, record_anti_join, sync_layout, odo_layout, ast_verb_counts, ast_call_graph, ast_expression, source_printed, source_errors, copybook_entry_rows)}
    sql = {
        "record_decode_agg": f"SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS customers, CAST(sum({CENTS % 'c_acctbal'}) AS BIGINT) AS balance_cents FROM customer GROUP BY 1",
        "record_filter_project": "SELECT c_custkey AS custkey, rtrim(c_name) AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
        "record_join": f"SELECT n_name, max({CENTS % 'c_acctbal'}) AS most_cents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "packed_encode": f"SELECT c_custkey, lpad(CAST(abs(v) AS VARCHAR), 9, '0') || CASE WHEN v < 0 THEN 'D' ELSE 'C' END AS bytes FROM (SELECT c_custkey, {CENTS % 'c_acctbal'} AS v FROM customer)",
        "packed_unsigned_even": "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 5, '0') || 'F' AS bytes FROM part",
        "packed_roundtrip": f"SELECT c_custkey, {CENTS % 'c_acctbal'} AS cents FROM customer",
        "comp6_encode": "SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS bytes FROM orders",
        "comp6_roundtrip": "SELECT o_orderkey, o_custkey AS custkey FROM orders",
        "comp5_full_range": "SELECT o_orderkey, o_orderkey % 65536 AS v, o_orderkey % 32768 - 16384 AS w FROM orders",
        "alnum_cp037": "SELECT c_custkey, rtrim(c_name) AS name, ltrim(c_mktsegment) AS segment FROM customer",
        "alnum_cp037_bytes": "SELECT o_orderkey, regexp_replace(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), '(.)', 'F\\1', 'g') || '4040' AS bytes FROM orders",
        "redefines_union": f"SELECT 'C' AS kind, c_custkey AS id, rtrim(c_name) AS name, NULL::BIGINT AS cents FROM customer UNION ALL SELECT 'S', s_suppkey, NULL, {CENTS % 's_acctbal'} FROM supplier",
        "level88_in_tables": "SELECT c_custkey AS custkey, length(regexp_replace(substr(c_mktsegment, 1, 5), '[^AEIOU]', '', 'g')) AS vowels, length(regexp_replace(substr(c_mktsegment, 1, 5), '[^A-I]', '', 'g')) AS early FROM customer",
        "integral_types": f"SELECT o_custkey AS custkey, CAST(sum({CENTS % 'o_totalprice'}) AS BIGINT) AS price, max(o_orderkey) AS last_order FROM orders GROUP BY o_custkey",
        "level88": "SELECT c_custkey AS custkey, c_mktsegment = 'BUILDING' AS builds, c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS moves, floor(c_acctbal) BETWEEN -9999999 AND -1 AS owes FROM customer",
        "renames": "SELECT c_custkey AS custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') || 'F' AS key_bytes, 17::BIGINT AS bytes FROM customer",
        "fault_report": "SELECT c_custkey, 'V' AS field, CASE WHEN c_custkey % 7 = 0 THEN 6 ELSE 9 END::BIGINT AS at, CASE WHEN c_custkey % 7 = 0 THEN 'packed_digit' ELSE 'packed_sign' END AS kind FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0",
        "drop_malformed": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey % 3 <> 0",
        "record_window": f"SELECT nation, place, c_custkey AS custkey FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {CENTS % 'c_acctbal'} DESC, c_custkey) AS place FROM customer) WHERE place <= 3",
        "record_rollup": f"SELECT nation, segment, CAST(sum(v) AS BIGINT) AS cents FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, rtrim(c_mktsegment) AS segment, {CENTS % 'c_acctbal'} AS v FROM customer) GROUP BY ROLLUP (nation, segment)",
        "record_anti_join": "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 40 = 0)",
        "sync_layout": "SELECT * FROM (VALUES ('R',0,24,0),('A',0,1,0),('B',4,4,3),('C',8,4,0),('D',8,1,0),('E',10,2,1),('F',16,8,0)) t(name,start,length,slack)",
        "odo_layout": "SELECT CAST(n AS INTEGER) AS n, CAST(2 + 3 * n AS INTEGER) AS tail, CAST(6 + 3 * n AS INTEGER) AS length FROM range(1, 6) t(n)",
        "ast_verb_counts": "SELECT * FROM (VALUES ('CallStatement', 4::BIGINT),('IfStatement',1),('DisplayStatement',1),('PerformStatement',1),('StopStatement',1),('ComputeStatement',1),('GobackStatement',1)) t(kind, statements)",
        "ast_call_graph": "SELECT * FROM (VALUES ('a.cob','B',1::BIGINT),('a.cob','C',1),('b.cob','C',2)) t(path, called, calls)",
        "ast_expression": "SELECT 'b.cob' AS path, '+' AS outer_op, '*' AS inner_op",
        "source_printed": "SELECT 'IDENTIFICATION DIVISION.' || chr(10) || 'PROGRAM-ID. a.' || chr(10) || 'PROCEDURE DIVISION.' || chr(10) || 'm.' || chr(10) || '    IF a > 1' || chr(10) || '        DISPLAY ' || chr(39) || 'b' || chr(39) || chr(10) || '    END-IF.' || chr(10) AS text",
        "source_errors": "SELECT 'bad.cob' AS path, 'UnexpectedTokenError' AS kind",
        "copybook_entry_rows": "SELECT * FROM (VALUES (0,1,'R',NULL,NULL,NULL,NULL::INTEGER,NULL::INTEGER,NULL),(1,5,'A','9(4)','comp-3',NULL,NULL,NULL,NULL),(2,5,NULL,'X',NULL,NULL,2,5,'A'),(3,5,'B','X(3)',NULL,'A',NULL,NULL,NULL)) t(seq,level,name,picture,usage,redefines,occurs_min,occurs_max,depending)",
        "picture_info": PICTURE_SQL, "layout_items": LAYOUT_SQL, "tokens": TOKENS_SQL,
    }
    for sign in SIGN_TABLES:
        own[f"zoned_{sign}_bytes"], own[f"zoned_{sign}_roundtrip"] = _zoned(sign)
        sql[f"zoned_{sign}_bytes"] = _zoned_sql(sign)
        sql[f"zoned_{sign}_roundtrip"] = f"SELECT c_custkey, v AS t, v AS l, v AS ts, v AS ls, abs(v) AS u FROM (SELECT c_custkey, {CENTS % 'c_acctbal'} AS v FROM customer)"
    for staircase in STAIRCASES:
        for order in ("big", "little"):
            name = f"binary_{staircase.replace('--', 'to').replace('-', '')}_{order}"
            own[f"{name}_bytes"], own[f"{name}_roundtrip"] = _binary(staircase, order)
            sql[f"{name}_bytes"], sql[f"{name}_roundtrip"] = _binary_sql(staircase, order), _binary_values_sql()
    for kind in ("ibm", "gnucobol", "microfocus"):
        name = {"ibm": "float_hfp", "gnucobol": "float_ieee_big", "microfocus": "float_ieee_little"}[kind]
        own[name], sql[name] = _float(kind), FLOAT_SQL
    own["occurs_explode"], sql["occurs_explode"] = _occurs("7 TIMES"), OCCURS_SQL
    own["odo_explode"], sql["odo_explode"] = _occurs("0 TO 7 TIMES DEPENDING ON LINE-COUNT"), OCCURS_SQL
    return own, sql


def queries() -> dict:
    return _both()[0]


def oracle_sql() -> dict[str, str]:
    return _both()[1]
