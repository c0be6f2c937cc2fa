"""More of the record and source operators as queries, each over whole tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch
from ..sources import records as files
from ..streaming import records as streams
from . import source
from .queries import CENTS, LETTERS, ORDER, cents, customer_records, fmt, table
from .queries import _ibm_customers as customers_format
from .records import decode_records, encode_records

COUNTED = """
01 SHIPMENT.
   05 ORDER-KEY PIC 9(12) COMP-3.
   05 BOXES PIC S9(2).
   05 BOX PIC X(2) OCCURS 1 TO 9 TIMES DEPENDING ON BOXES.
   05 OWNER PIC 9(6).
"""


def odo_bad_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh record holds a count that is no number, or out of bounds: all behind it is null, and the fault listed."""
    f, n = fmt(COUNTED), (F.col("o_orderkey") % 9 + 1).cast("int")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ORDER-KEY"), n.alias("BOXES"), F.array_repeat(F.lit("ab"), n).alias("BOX"), F.col("o_custkey").alias("OWNER"))
    h = F.hex("value")
    bad = F.when(F.col("ORDER-KEY") % 22 == 0, "F0F0").when(F.col("ORDER-KEY") % 11 == 0, "C1C2").otherwise(F.substring(h, 15, 4))
    raw = encode_records(own, f, ("ORDER-KEY",)).select(F.unhex(F.concat(F.substring(h, 1, 14), bad, F.expr("substring(hex(value), 19)"))).alias("value"))
    out = decode_records(raw, f, mode="PERMISSIVE")
    faults = F.transform("_faults", lambda x: F.concat_ws(":", x["field"], x["offset"], x["kind"]))
    return out.select(F.col("ORDER-KEY").cast("long").alias("orderkey"), F.col("BOXES").cast("long").alias("boxes"), F.when(F.col("BOX").isNotNull(), F.size("BOX").cast("long")).alias("items"), F.col("OWNER").cast("long").alias("owner"), F.array_join(faults, ",").alias("faults"))


BAD_COUNTS_SQL = """
SELECT o_orderkey AS orderkey, CASE WHEN o_orderkey % 22 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 9 + 1 END AS boxes,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 9 + 1 END AS items, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS owner,
  CASE WHEN o_orderkey % 22 = 0 THEN 'BOXES:7:occurs_count' WHEN o_orderkey % 11 = 0 THEN 'BOXES:7:zoned_digit' ELSE '' END AS faults FROM orders"""


def encode_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not fit an item is listed and not written: too many digits, too many decimals, too long a text, nulls, tables too long."""
    f = fmt("01 R. 05 OWNER PIC 9(3). 05 PRICE PIC 9(9)V9 COMP-3. 05 RANK PIC X(8). 05 STATUS PIC X. 05 MARK PIC X OCCURS 4.")
    own = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("OWNER"), (cents("o_totalprice").cast("decimal(15,0)") / 100).cast("decimal(12,2)").alias("PRICE"), F.col("o_orderpriority").alias("RANK"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("STATUS"), F.array_repeat(F.lit("x"), (F.col("o_orderkey") % 7).cast("int")).alias("MARK"))
    out = encode_records(own, f, ("o_orderkey",), mode="PERMISSIVE")
    return out.select("o_orderkey", F.array_join(F.transform("_faults", lambda x: F.concat_ws(":", x["field"], x["kind"])), ",").alias("faults"), F.col("value").isNotNull().alias("written"))


ENCODE_FAULTS_SQL = f"""
SELECT o_orderkey, faults, faults = '' AS written FROM (SELECT o_orderkey, concat_ws(',',
  CASE WHEN o_custkey > 999 THEN 'OWNER:zoned_range' END, CASE WHEN {CENTS % 'o_totalprice'} % 10 <> 0 THEN 'PRICE:scale' END,
  CASE WHEN length(o_orderpriority) > 8 THEN 'RANK:field_too_long' END, CASE WHEN o_orderstatus = 'P' THEN 'STATUS:null_value' END,
  CASE WHEN o_orderkey % 7 > 4 THEN 'MARK:occurs_count' END) AS faults FROM orders)"""


def fixed_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to record files in two appends, and read back."""
    path = f"{scratch(spark)}/fixed-{uuid.uuid4().hex}"
    own = decode_records(customer_records(spark, sf_dir), customers_format())
    for part in (own.where(F.col("CUST-BALANCE") < 0), own.where(F.col("CUST-BALANCE") >= 0)):
        files.write_records(part, customers_format(), path)
    out = files.read_records(spark, f"{path}/part-*", customers_format())
    return out.select(F.col("CUST-KEY").cast("long").alias("custkey"), F.col("CUST-NAME").alias("name"), (F.col("CUST-BALANCE") * 100).cast("long").alias("cents"))


def _shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 9 + 1).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ORDER-KEY"), n.alias("BOXES"), F.array_repeat(F.lit("ab"), n).alias("BOX"), F.col("o_custkey").alias("OWNER"))


def variable_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of many lengths, written to files and read back by way of an index of their stretches."""
    f, path = fmt(COUNTED, "converted"), f"{scratch(spark)}/variable-{uuid.uuid4().hex}"
    files.write_records(_shipments(spark, sf_dir), f, path)
    index = files.index_variable(spark, f"{path}/part-*", f, stretch=1 << 18)
    out = decode_records(files.read_variable(spark, path, f, index=index), f)
    return out.select(F.col("ORDER-KEY").cast("long").alias("orderkey"), F.size("BOX").cast("long").alias("items"), F.col("OWNER").cast("long").alias("owner"))


EVENT = "01 E. 05 AT PIC 9(12) COMP-3. 05 USER PIC 9(9) COMP. 05 KIND PIC X(12). 05 AMOUNT PIC S9(9)V99 COMP-3."


def record_stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records that arrive as files, counted by kind over windows of a day behind a watermark."""
    f, path = fmt(EVENT), f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    own = table(spark, sf_dir, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("AT"), F.col("user_id").alias("USER"), F.col("event_type").alias("KIND"), (cents("value").cast("decimal(12,0)") / 100).cast("decimal(11,2)").alias("AMOUNT"))
    files.write_records(own, f, f"{path}/in")
    rows = streams.read_stream(spark, f"{path}/in", f, glob="part-*").withColumn("ts", F.timestamp_seconds(F.col("AT").cast("long"))).withWatermark("ts", "36500 days")
    day = F.floor(F.unix_seconds("window.start") / 86400).cast("long").alias("day")
    counted = rows.groupBy(F.window("ts", "1 day"), "KIND").agg(F.count("*").alias("n"), (F.sum("AMOUNT") * 100).cast("long").alias("cents"))
    out = []

    def keep(batch: DataFrame, _: int) -> None:
        target = f"{path}/out-{len(out)}"
        batch.select(day, F.col("KIND").alias("kind"), "n", "cents").write.parquet(target)
        out[:] = [target]

    # A group for each day and kind is little state: a part of it for each core, not for each of the session's shuffle partitions.
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(parts), spark.sparkContext.defaultParallelism)))
    try:
        query = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    query.awaitTermination()
    return spark.read.parquet(out[0]) if out else spark.createDataFrame([], "day long, kind string, n long, cents long")


def _nations(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "customer":
        return decode_records(customer_records(spark, sf_dir), customers_format()).select(F.col("CUST-NATION").cast("long").alias("nation"))
    f = fmt("01 S. 05 NATION PIC 9(4) COMP-6.")
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("NATION"))
    return decode_records(encode_records(own, f), f).select(F.col("NATION").cast("long").alias("nation"))


def record_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and suppliers: both, either, and customers' beyond one for each supplier."""
    a, b = _nations(spark, sf_dir, "customer"), _nations(spark, sf_dir, "supplier")
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "beyond": a.exceptAll(b)}
    out = None
    for name, own in parts.items():
        own = own.groupBy("nation").agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def record_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest balances, ties to the smaller key."""
    own = decode_records(customer_records(spark, sf_dir), customers_format())
    top = own.orderBy(F.desc("CUST-BALANCE"), "CUST-KEY").limit(20)
    return top.select(F.col("CUST-KEY").cast("long").alias("custkey"), (F.col("CUST-BALANCE") * 100).cast("long").alias("cents"))


def record_join_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order, over all orders."""
    own = decode_records(customer_records(spark, sf_dir), customers_format()).select(F.col("CUST-KEY").cast("long").alias("custkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return own.join(orders, own["custkey"] == orders["o_custkey"], "left_anti")


#: Lines of an order that are put into records together.
DEALT = 1280


def _lines(clause: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every line of every order, one table a record, as long as the order with most lines needs."""
        lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ORDER-KEY"), F.struct(F.col("l_linenumber").alias("LINE-NUMBER"), F.col("l_partkey").alias("PART"), F.col("l_quantity").cast("int").alias("QUANTITY")).alias("line"))
        # Orders are whole in one group each; one of very many lines is dealt over more, so none grows long and no record is filled for a line or two.
        parts = F.ceil(F.col("n") / DEALT).cast("int").alias("parts")
        heavy = lines.groupBy("ORDER-KEY").agg(F.count("*").alias("n")).where(F.col("n") > DEALT).select("ORDER-KEY", parts)
        place = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
        own = lines.join(F.broadcast(heavy), "ORDER-KEY", "left").groupBy("ORDER-KEY", place.alias("part")).agg(F.array_sort(F.collect_list("line")).alias("LINES"))
        own = own.select("ORDER-KEY", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("LINES") - 1) / 20).cast("int")), lambda k: F.slice("LINES", k * 20 + 1, F.lit(20)))).alias("LINES")).withColumn("LINE-COUNT", F.size("LINES"))
        f = fmt(ORDER % clause)
        out = decode_records(encode_records(own, f), f)
        flat = out.select(F.col("ORDER-KEY").cast("long").alias("orderkey"), F.explode(F.slice("LINES", F.lit(1), F.col("LINE-COUNT").cast("int"))).alias("x"))
        return flat.select("orderkey", F.col("x.LINE-NUMBER").cast("long").alias("linenumber"), F.col("x.PART").cast("long").alias("partkey"), F.col("x.QUANTITY").cast("long").alias("quantity"))

    return run


LINES_SQL = "SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, l_partkey AS partkey, CAST(floor(l_quantity) AS BIGINT) AS quantity FROM lineitem"


def level88_every_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of a table's items over every letter of the market segment."""
    c = table(spark, sf_dir, "customer")
    f = fmt(LETTERS % (c.agg(F.max(F.length("c_mktsegment"))).first()[0] or 1))
    own = c.select(F.col("c_custkey").alias("CUST-KEY"), F.split("c_mktsegment", "").alias("LETTER"))
    out = decode_records(encode_records(own, f), f, conditions=True)
    held = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    return out.select(F.col("CUST-KEY").cast("long").alias("custkey"), held("VOWEL").alias("vowels"), held("EARLY").alias("early"))


LETTERS_SQL = "SELECT c_custkey AS custkey, length(regexp_replace(c_mktsegment, '[^AEIOU]', '', 'g')) AS vowels, length(regexp_replace(c_mktsegment, '[^A-I]', '', 'g')) AS early FROM customer"


def _float_exact(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Doubles go through COMP-2 without a change of any bit."""
        f = fmt("01 R. 05 D COMP-2. 05 P COMP-2.", kind)
        own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("D"), F.col("l_extendedprice").alias("P"))
        out = decode_records(encode_records(own, f, ("l_orderkey", "l_linenumber")), f, keep=("l_orderkey", "l_linenumber"))
        return out.select("l_orderkey", "l_linenumber", F.col("D").alias("discount"), F.col("P").alias("price"))

    return run


FLOAT_EXACT_SQL = "SELECT l_orderkey, l_linenumber, l_discount AS discount, l_extendedprice AS price FROM lineitem"

#: One statement of every kind.
STATEMENTS = (
    "DISPLAY X", "MOVE A TO B", "ACCEPT A FROM DATE", "CALL 'P' USING A", "GO TO M", "CONTINUE", "IF A = B NEXT SENTENCE ELSE CONTINUE END-IF", "PERFORM M 3 TIMES", "ADD 1 TO B", "COMPUTE A = B + C * 2",
    "EXIT PARAGRAPH", "OPEN INPUT F1", "CLOSE F1", "READ F1 INTO R AT END CONTINUE END-READ", "WRITE R FROM S", "REWRITE R FROM S", "DELETE F1 RECORD", "START F1 KEY IS = K",
    "SORT F1 ON ASCENDING KEY A USING G GIVING H", "MERGE F1 ON ASCENDING KEY A USING G H GIVING I", "RELEASE R FROM S", "RETURN F1 RECORD INTO R AT END CONTINUE END-RETURN",
    "EVALUATE A WHEN 1 CONTINUE END-EVALUATE", "INITIALIZE A", "SET I UP BY 2", "STRING A DELIMITED BY SIZE INTO D", "UNSTRING A DELIMITED BY ',' INTO B", "INSPECT A REPLACING ALL 'x' BY 'y'",
    "SEARCH T WHEN A = 1 CONTINUE END-SEARCH", "STOP 'wait'", "GOBACK",
)
KINDS = {"Accept": 1, "Arithmetic": 1, "Call": 1, "Close": 1, "Compute": 1, "Continue": 6, "Delete": 1, "Display": 1, "Evaluate": 1, "Exit": 1, "GoTo": 1, "Goback": 1, "If": 1, "Initialize": 1, "Inspect": 1, "Merge": 1, "Move": 1, "NextSentence": 1, "Open": 1, "Perform": 1, "Read": 1, "Release": 1, "Return": 1, "Rewrite": 1, "Search": 1, "Set": 1, "Sort": 1, "Start": 1, "Stop": 1, "String": 1, "Unstring": 1, "Write": 1}


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program of every kind of statement for each nation."""
    body = ". ".join(STATEMENTS)
    text = F.concat(F.lit("IDENTIFICATION DIVISION. PROGRAM-ID. P"), F.col("n_nationkey").cast("string"), F.lit(f". PROCEDURE DIVISION. M. {body}."))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), text.alias("content"))


def ast_every_verb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of each kind over the programs of all nations, parsed, printed and parsed again."""
    shown = source.printed(_programs(spark, sf_dir)).select("path", F.col("text").alias("content"))
    return source.verb_counts(source.ast_nodes(shown))


VERBS_SQL = "SELECT kind || 'Statement' AS kind, CAST(k * n AS BIGINT) AS statements FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in KINDS.items()) + ") t(kind, k), (SELECT count(*) AS n FROM nation)"

FIXED = """000100 IDENTIFICATION DIVISION.                                             X
000200 PROGRAM-ID. P%s.                                                     X
000300 ENVIRONMENT DIVISION.                                                X
000400 INPUT-OUTPUT SECTION.                                                X
000500 FILE-CONTROL.                                                        X
000600     SELECT OPTIONAL F1 ASSIGN TO 'f' ORGANIZATION IS INDEXED         X
000700         ACCESS MODE IS DYNAMIC RECORD KEY IS K.                      X
000800* A note that no column of the area holds                             X
000900 DATA DIVISION.                                                       X
001000 FILE SECTION.                                                        X
001100 FD F1.                                                               X
001200 COPY REC REPLACING ==TAG== BY ==N%s==.                               X
001300 WORKING-STORAGE SECTION.                                             X
001400 01 TOTALS.                                                           X
001500    05 T PIC S9(3) COMP-3 OCCURS 2 TO %s DEPENDING ON N.              X
001600 PROCEDURE DIVISION.                                                  X
001700 M.                                                                   X
001800     STOP RUN.                                                        X
"""
BOOK = "000100 01 TAG.\n000200    05 K PIC 9(4).\n000300       88 NONE VALUE ZERO.\n000400    05 N PIC 9(2) COMP."


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.format_string(FIXED, key, key, (F.col("n_nationkey") + 2).cast("string")).alias("content"))


def fixed_copy_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data clauses of fixed-format programs with a copybook each, its names replaced; a node for each clause."""
    own = source.clauses(source.ast_nodes(_sources(spark, sf_dir), True, {"REC": BOOK}))
    return own.select("path", "level", "name", F.regexp_replace("kind", "Clause$", "").alias("clause"), F.coalesce(F.col("attrs")["picture"], F.col("attrs")["usage"], F.concat_ws("-", F.col("attrs")["min"], F.col("attrs")["max"])).alias("what"))


CLAUSES_SQL = """
SELECT n_name AS path, level, name, clause, CASE what WHEN '2-' THEN '2-' || (n_nationkey + 2) ELSE what END AS what FROM nation,
(VALUES ('05','K','Picture','9(4)'),('88','NONE','Value',''),('05','N','Picture','9(2)'),('05','N','Usage','COMP'),('05','T','Picture','S9(3)'),('05','T','Usage','COMP-3'),('05','T','Occurs','2-')) t(level, name, clause, what)"""


def environment_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the programs with their clauses, from the ENVIRONMENT DIVISION, and the records that a copybook gives them."""
    nodes = source.ast_nodes(_sources(spark, sf_dir), True, {"REC": BOOK})
    entries = nodes.where("kind = 'FileControlEntry'").select("path", F.col("node_id").alias("e"), F.col("attrs")["optional"].alias("optional"))
    under = nodes.select(F.col("path").alias("p"), F.col("parent_id").alias("up"), "kind", "attrs")
    both = entries.join(under, (F.col("path") == F.col("p")) & (F.col("e") == F.col("up")))
    facts = both.groupBy("path", "optional").agg(F.max(F.col("attrs")["organization"]).alias("organization"), F.max(F.col("attrs")["mode"]).alias("access"))
    records = nodes.where("role = 'record' AND attrs['level'] = '01'").select(F.col("path").alias("p"), F.col("attrs")["name"].alias("record"))
    return facts.join(records, F.col("path") == F.col("p")).select("path", "optional", "organization", "access", "record")


ENVIRONMENT_SQL = "SELECT n_name AS path, 'true' AS optional, 'INDEXED' AS organization, 'DYNAMIC' AS access, 'N' || n_nationkey AS record FROM nation"


def fragment_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copybook for each part, parsed alone and printed in canonical form; a comma stands for the decimal point."""
    text = F.concat(F.lit("01 part-"), F.col("p_partkey").cast("string"), F.lit(". 05 size pic 9(4)v9 comp-3 value "), F.col("p_size").cast("string"), F.lit(",5. 05 name pic x("), F.length("p_name").cast("string"), F.lit(") just."))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), text.alias("content"))
    return source.printed(own, fragment=True, decimal_comma=True).select(F.col("path").cast("long").alias("partkey"), "text")


FRAGMENT_SQL = """
SELECT p_partkey AS partkey, '01 part-' || p_partkey || '.' || chr(10) || '    05 size PIC 9(4)v9 USAGE COMP-3 VALUE ' || p_size || ',5.' || chr(10)
  || '    05 name PIC x(' || length(p_name) || ') JUSTIFIED RIGHT.' || chr(10) AS text FROM part"""


def picture_info_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """picture_info() as a scalar SQL function over the pictures that the sizes of all parts make."""
    source.register_functions(spark)
    source.spread(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("S9("), F.col("p_size").cast("string"), F.lit(")V99")).alias("p"))).createOrReplaceTempView("mainspring_pictures")
    return spark.sql("SELECT p_partkey, i.category, i.digits, i.scale, i.signed, i.size FROM (SELECT p_partkey, picture_info(p) AS i FROM mainspring_pictures)")


PICTURE_INFO_SQL = "SELECT p_partkey, 'numeric' AS category, p_size + 2 AS digits, 2 AS scale, true AS signed, p_size + 2 AS size FROM part"


def token_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cobol_tokens() as a table function, joined laterally to statements made of the names of all customers."""
    source.register_functions(spark)
    source.spread(table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("DISPLAY '"), F.col("c_name"), F.lit("' "), F.col("c_custkey").cast("string"), F.lit(".")).alias("s"))).createOrReplaceTempView("mainspring_statements")
    return spark.sql("SELECT c_custkey, t.seq, t.col, t.type, t.value FROM mainspring_statements, LATERAL cobol_tokens(s) t")


TOKEN_SQL = """
WITH o AS (SELECT c_custkey, c_name, 12 + length(c_name) AS a, CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT c_custkey, 0 AS seq, 1 AS col, 'Identifier' AS type, 'DISPLAY' AS value FROM o UNION ALL
SELECT c_custkey, 1, 9, 'String', chr(39) || c_name || chr(39) FROM o UNION ALL
SELECT c_custkey, 2, CAST(a AS INTEGER), 'Number', k FROM o UNION ALL
SELECT c_custkey, 3, CAST(a + length(k) AS INTEGER), 'Symbol', '.' FROM o"""


def queries_and_sql() -> dict[str, tuple]:
    own = {
        "odo_bad_counts": (odo_bad_counts, BAD_COUNTS_SQL),
        "encode_faults": (encode_faults, ENCODE_FAULTS_SQL),
        "fixed_file_roundtrip": (fixed_file_roundtrip, f"SELECT c_custkey AS custkey, rtrim(c_name) AS name, {CENTS % 'c_acctbal'} AS cents FROM customer"),
        "variable_file_roundtrip": (variable_file_roundtrip, "SELECT o_orderkey AS orderkey, o_orderkey % 9 + 1 AS items, o_custkey AS owner FROM orders"),
        "record_stream_window": (record_stream_window, f"SELECT CAST(floor(epoch(date_trunc('day', ts)) / 86400) AS BIGINT) AS day, event_type AS kind, count(*) AS n, CAST(sum({CENTS % 'value'}) AS BIGINT) AS cents FROM events GROUP BY 1, 2"),
        "record_set_operations": (record_set_operations, "WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer), b AS (SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier) SELECT nation, count(*) AS n, 'both' AS what FROM (SELECT nation FROM a INTERSECT SELECT nation FROM b) GROUP BY nation UNION ALL SELECT nation, count(*), 'either' FROM (SELECT nation FROM a UNION SELECT nation FROM b) GROUP BY nation UNION ALL SELECT nation, count(*), 'beyond' FROM (SELECT nation FROM a EXCEPT ALL SELECT nation FROM b) GROUP BY nation"),
        "record_top": (record_top, f"SELECT c_custkey AS custkey, {CENTS % 'c_acctbal'} AS cents FROM customer ORDER BY 2 DESC, 1 LIMIT 20"),
        "customers_without_urgent": (record_join_any, "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
        "occurs_every_line": (_lines("20 TIMES"), LINES_SQL),
        "odo_every_line": (_lines("1 TO 20 TIMES DEPENDING ON LINE-COUNT"), LINES_SQL),
        "level88_every_letter": (level88_every_letter, LETTERS_SQL),
        "ast_every_verb": (ast_every_verb, VERBS_SQL),
        "fixed_copy_clauses": (fixed_copy_clauses, CLAUSES_SQL),
        "environment_entries": (environment_entries, ENVIRONMENT_SQL),
        "fragment_printed": (fragment_printed, FRAGMENT_SQL),
        "picture_info_function": (picture_info_function, PICTURE_INFO_SQL),
        "token_function": (token_function, TOKEN_SQL),
    }
    for kind, name in (("ibm", "hfp"), ("gnucobol", "ieee_big"), ("microfocus", "ieee_little")):
        own[f"float_exact_{name}"] = (_float_exact(kind), FLOAT_EXACT_SQL)
    return own
