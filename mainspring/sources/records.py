"""Record files as DataFrames.

Fixed-length files are read by Hadoop's fixed-length input format inside the JVM: splits fall
on record boundaries, any file system that Spark reads will do, and no Python touches a byte.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import Encoding, sign_readings
from ..operators.records import RecordFormat, decode_records, encode_records
from ..plans.layout import Item


def read_fixed(spark: SparkSession, path: str, length: int) -> DataFrame:
    """One binary column, `value`, with a row for every record of `length` bytes."""
    jvm = spark.sparkContext._jvm
    rows = spark.sparkContext._jsc.sc().binaryRecords(path, length, spark.sparkContext._jsc.hadoopConfiguration())
    return DataFrame(spark._jsparkSession.createDataset(rows, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)


PIECE = 1 << 24
STRETCH = 1 << 26


def _file_system(uri: str):
    """Arrow's file system and path for a qualified Hadoop path."""
    import pyarrow.fs as fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    return fs.FileSystem.from_uri(quote(f"{scheme}:{rest}", safe=":/@"))


def _digits_of(raw: bytes, signed: bool, sign: tuple[str, bool], encoding: Encoding) -> int | None:
    """The whole number of zoned bytes: plain digits of either charset, else by the file's signs; None if it is none."""
    leading, separate = sign[0] == "leading", signed and sign[1]
    if separate:
        mark, raw = (raw[0], raw[1:]) if leading else (raw[-1], raw[:-1])
        if mark not in (0x2B, 0x4E):
            return None
    digits = [b & 15 if b >> 4 in (3, 15) and b & 15 <= 9 else None for b in raw]
    if signed and not separate:
        at = 0 if leading else len(raw) - 1
        own = raw[at]
        reading = sign_readings(encoding.sign).get(own)
        digits[at] = own & 15 if own >> 4 in (3, 4, 12, 15) and own & 15 <= 9 else reading[0] if reading and not (reading[1] and reading[0]) else None
    return None if None in digits else int("".join(map(str, digits)))


def _occurrences(data: memoryview, table: Item, counts, encoding: Encoding) -> int | None:
    """The number of occurrences of a table, from its controlling item in the record at the start of data; None if it is faulty."""
    item = table.control
    start, width, usage, p = item.at.value(counts), item.length_.value(counts), item.field.usage, item.field.picture
    raw = bytes(data[start : start + width])
    if len(raw) < width:
        return None
    if usage in ("binary", "comp-5"):
        return int.from_bytes(raw, encoding.byte_order, signed=p.signed)
    if usage == "display":
        return _digits_of(raw, p.signed, item.sign() or ("trailing", False), encoding)
    nibbles = [n for b in raw for n in (b >> 4, b & 15)]
    if usage == "comp-3":
        if nibbles.pop() not in (10, 12, 14, 15):
            return None
    return int("".join(map(str, nibbles))) if max(nibbles) <= 9 and not any(nibbles[: len(nibbles) - p.digits]) else None


def frames(read, fmt: RecordFormat, path: str, start: int = 0):
    """The records of a file, each as (offset, bytes); read(n) gives its next n bytes or fewer, from `start` on.

    No more than a piece of the file and one record are held at a time.
    """
    root, most = fmt.layout.root, fmt.layout.max_length
    data, at, passed, more = b"", 0, start, True
    while True:
        if more and len(data) - at < most:
            piece = read(max(PIECE, most))
            more, data, passed, at = bool(piece), data[at:] + piece, passed + at, 0
            continue
        if at >= len(data):
            return
        own, known = memoryview(data)[at : at + most], {}

        def counts(t, own=own, known=known, where=passed + at):
            if t not in known:
                n = _occurrences(own, t, counts, fmt.encoding)
                if n is None or not t.min_occurs <= n <= t.max_occurs:
                    raise ValueError(f"{path}: {n} occurrences of {t.name} at byte {where}")
                known[t] = n
            return known[t]

        size = root.total_.value(counts)
        if size <= 0 or size > len(own):
            raise ValueError(f"{path}: record at byte {passed + at} ends beyond the file")
        yield passed + at, bytes(own[:size])
        at += size


def cut_files(files: DataFrame, fmt: RecordFormat) -> DataFrame:
    """path, seq, offset, value: the records of files, from their path and content.

    Where content is null the file is streamed by its path through Arrow's file systems, from
    `start` for `size` bytes if files has these columns, else whole. seq counts the rows of one
    file or stretch, offset is the record's place in the file.
    """
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("value", pa.binary())])
    ranged = "start" in files.columns

    def batch_of(path, first, rows):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(first, first + len(rows)), pa.int64()), pa.array([o for o, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], schema=schema)

    def run(batches):
        for batch in batches:
            ranges = zip(batch.column("start").to_pylist(), batch.column("size").to_pylist(), strict=True) if ranged else [(0, None)] * batch.num_rows
            for path, content, (start, size) in zip(batch.column("path").to_pylist(), batch.column("content"), ranges, strict=True):
                if content.is_valid:
                    source = pa.BufferReader(content.as_buffer())
                else:
                    system, own = _file_system(path)
                    source = system.open_input_file(own) if size is not None else system.open_input_stream(own)
                    if size is not None:
                        source.seek(start)
                left = [size]

                def read(n, source=source, left=left):
                    piece = source.read(n if left[0] is None else min(n, left[0]))
                    left[0] = None if left[0] is None else left[0] - len(piece)
                    return piece

                first, rows, held = 0, [], 0
                with source:
                    for row in frames(read, fmt, path, start):
                        rows.append(row)
                        held += len(row[1])
                        if len(rows) == 4096 or held >= PIECE:
                            yield batch_of(path, first, rows)
                            first, rows, held = first + len(rows), [], 0
                if rows:
                    yield batch_of(path, first, rows)

    own = files.select("path", "content", *(["start", "size"] if ranged else []))
    return own.mapInArrow(run, "path string, seq long, offset long, value binary")


def cut_fixed(files: DataFrame, length: int) -> DataFrame:
    """path, seq, offset, value: the records of `length` bytes of files, from their path, length and content.

    Where content is null a file is read by its path through Arrow's file systems, in stretches
    of whole records that are dealt over the cluster, so neither a file nor an array of its
    records is ever one row. The last record of a file may be shorter.
    """
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.binary())])
    most = max(1, min(PIECE // length, 1 << 16))

    def run(batches):
        import numpy as np

        for batch in batches:
            for path, content, start, size in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("start").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if content.is_valid:
                    source = pa.BufferReader(content.as_buffer())
                else:
                    system, own = _file_system(path)
                    source = system.open_input_file(own)
                with source:
                    source.seek(start)
                    at = start
                    while at < start + size:
                        piece = source.read_buffer(min(most * length, start + size - at))
                        n, rest = divmod(len(piece), length)
                        if at + len(piece) < start + size and (rest or not n):
                            raise OSError(f"{path}: {start + size} bytes announced, {at + len(piece)} read")
                        if n:
                            value = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, piece.slice(0, n * length)]).cast(pa.binary())
                            yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(at + length * np.arange(n, dtype=np.int64)), value], schema=schema)
                        if rest:
                            yield pa.RecordBatch.from_pydict({"path": [path], "offset": [at + n * length], "value": [piece.slice(n * length).to_pybytes()]}, schema=schema)
                        at += len(piece)

    step = max(1, STRETCH // length) * length
    starts = F.when(F.col("content").isNull(), F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    size = F.when(F.col("content").isNull(), F.least(F.lit(step).cast("long"), F.col("length") - F.col("start"))).otherwise(F.col("length"))
    own = files.where("length > 0").select("path", "length", "content", F.explode(starts).alias("start")).select("path", "start", size.alias("size"), "content")
    cut = own.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "path string, offset long, value binary")
    return cut.select("path", F.expr(f"offset div {length}").alias("seq"), "offset", "value")


def index_variable(spark: SparkSession, path: str, fmt: RecordFormat, stretch: int = 128 << 20) -> DataFrame:
    """path, start, size: stretches of whole records of variable files, each of about `stretch` bytes.

    Records carry no mark, so finding the stretches walks each file once, in one task. Written
    once, the index lets read_variable() read each stretch in a task of its own, ever after.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("path", F.lit(None).cast("binary").alias("content"))

    def run(batches):
        start, size, at = 0, 0, None
        for batch in batches:
            for own, offset, value in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("value"), strict=True):
                if at is not None and (own != at or size >= stretch):
                    yield pa.RecordBatch.from_pydict({"path": [at], "start": [start], "size": [size]})
                    at = None
                if at is None:
                    at, start, size = own, offset, 0
                size += len(value.as_buffer())
        if at is not None:
            yield pa.RecordBatch.from_pydict({"path": [at], "start": [start], "size": [size]})

    return cut_files(files, fmt).mapInArrow(run, "path string, start long, size long")


def read_variable(spark: SparkSession, path: str, fmt: RecordFormat, whole: int = 0, index: DataFrame | None = None) -> DataFrame:
    """Records of a layout with DEPENDING ON tables, one after another in each file: path, seq, offset, value.

    A record's end is known only once it is read, so each file is walked from its start, one
    task a file; with an index (see index_variable) one task a stretch. Files are streamed piece
    by piece through Arrow's file systems, whatever their size. For file systems that only Spark
    knows, `whole` names the size up to which files are fetched by Spark, in one piece each.
    """
    if index is not None:
        stretches = index.select("path", "start", "size", F.lit(None).cast("binary").alias("content"))
        return cut_files(stretches.repartition(max(1, index.count()), "path", "start"), fmt)
    files = spark.read.format("binaryFile").load(path)
    if whole <= 0:
        return cut_files(files.select("path", F.lit(None).cast("binary").alias("content")), fmt)
    long = files.where(F.col("length") > whole).select("path", F.lit(None).cast("binary").alias("content"))
    return cut_files(files.where(F.col("length") <= whole).select("path", "content").unionByName(long), fmt)


def read_records(spark: SparkSession, path: str, fmt: RecordFormat, mode: str = "FAILFAST", **options) -> DataFrame:
    """A record file decoded: typed columns of its layout."""
    raw = read_variable(spark, path, fmt) if fmt.layout.variable else read_fixed(spark, path, fmt.layout.length)
    return decode_records(raw, fmt, "value", mode, **options)


def write_records(df: DataFrame, fmt: RecordFormat, path: str, mode: str = "append", nulls: str = "fail") -> int:
    """Encode df and write part files of bare records into the folder `path`; the number of records.

    Tasks write whole Arrow batches to files of their own in a staging folder below `path`, on
    any file system that Arrow and Hadoop both know. Once all are done, the driver renames one
    file for each partition to a name of this job's own, by Hadoop's API; a job that fails, and
    attempts that were lost or repeated, leave nothing behind. mode is append, which keeps what
    is there, overwrite, which takes away earlier part files after the new ones are written, or
    error, which refuses a folder that has part files. An empty partition writes no file.
    """
    import uuid

    import pyarrow as pa

    if mode not in ("append", "overwrite", "error"):
        raise ValueError(f"mode {mode!r} is none of append, overwrite, error")
    spark = df.sparkSession
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    system = hadoop.Path(path).getFileSystem(conf)
    target = system.makeQualified(hadoop.Path(path))
    job = uuid.uuid4().hex
    staging = hadoop.Path(target, f"_staging-{job}")
    earlier = [f.getPath() for f in system.listStatus(target) if f.getPath().getName().startswith("part-")] if system.exists(target) else []
    if mode == "error" and earlier:
        raise FileExistsError(f"{path} has part files")
    folder = staging.toString()

    def run(batches):
        from pyspark import TaskContext

        name, out, rows, size = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", None, 0, 0
        arrow, own = _file_system(folder)
        try:
            for batch in batches:
                values = batch.column("value").cast(pa.large_binary())
                if not len(values):
                    continue
                if out is None:
                    arrow.create_dir(own, recursive=True)
                    out = arrow.open_output_stream(f"{own}/{name}")
                first, last = (int.from_bytes(values.buffers()[1].slice(8 * (values.offset + k), 8).to_pybytes(), "little") for k in (0, len(values)))
                out.write(values.buffers()[2].slice(first, last - first))
                rows, size = rows + len(values), size + last - first
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]})

    moved = []
    try:
        done = encode_records(df, fmt, nulls=nulls).select("value").mapInArrow(run, "name string, rows long").collect()
        for r in done:
            new = hadoop.Path(target, f"part-{r['name'][:5]}-{job}")
            if not system.rename(hadoop.Path(staging, r["name"]), new):
                raise OSError(f"{path}: could not rename {r['name']}")
            moved.append(new)
    except BaseException:
        for new in moved:
            system.delete(new, False)
        raise
    finally:
        system.delete(staging, True)
    if mode == "overwrite":
        for old in earlier:
            system.delete(old, False)
    return sum(r["rows"] for r in done)
