"""Records that arrive as a stream: the same expressions over a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import RecordFormat, decode_records
from ..sources.records import cut_files, cut_fixed


def read_stream(spark: SparkSession, path: str, fmt: RecordFormat, mode: str = "PERMISSIVE", glob: str = "*", whole: int = 0) -> DataFrame:
    """Record files that arrive in a folder, decoded; `_path`, `_seq` and `_offset` say where from.

    Files are read by their paths through Arrow's file systems: fixed-length ones in stretches
    that are dealt over the cluster, variable ones streamed by one task each, whatever their
    size. For file systems that only Spark knows, `whole` names the size up to which files are
    fetched by Spark, in one piece each.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    named = files.select("path", "length", F.lit(None).cast("binary").alias("content"))
    if whole > 0:
        named = files.where(F.col("length") <= whole).select("path", "length", "content").unionByName(named.where(F.col("length") > whole))
    cut = cut_files(named, fmt) if fmt.layout.variable else cut_fixed(named, fmt.layout.length)
    return decode_records(cut.withColumnsRenamed({"path": "_path", "seq": "_seq", "offset": "_offset"}), fmt, "value", mode, keep=("_path", "_seq", "_offset"))
