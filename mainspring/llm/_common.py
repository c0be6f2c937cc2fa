"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words in every operator: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where there is no cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="mainspring-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage.

    The folder goes with drop_materialised(), or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mainspring-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(own)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(df: DataFrame) -> None:
    """Delete what materialise() wrote, once no later plan reads it."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/mainspring-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_keys(docs: DataFrame, keys: DataFrame, on: dict[str, Column], how: str, most: int = 64 << 20) -> DataFrame:
    """docs semi or anti joined with the distinct rows of a table of longs, null matching null.

    `on` gives the column of docs that each column of keys is held against. The keys are
    written and counted first: up to `most` bytes of them are broadcast, so the texts stay where
    they are; more are joined by a shuffle.
    """
    keys = materialise(keys.select(*[F.col(c).cast("long").alias(f"_key_{c}") for c in keys.columns]).distinct())
    side = F.broadcast(keys) if keys.count() * 16 * len(keys.columns) <= most else keys
    test = None
    for c, own in on.items():
        same = own.eqNullSafe(keys[f"_key_{c}"])
        test = same if test is None else test & same
    return docs.join(side, test, how)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: Column, modulus: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def class_sample(rows: DataFrame, key: str, label: str, per_class: int, seed: int, most: int | None = None) -> tuple[DataFrame, dict]:
    """A seeded sample of about per_class keys of each label, and every label's full row count.

    A key is kept if its hash falls under per_class / count, so the sample doesn't depend on
    how rows are partitioned. With more labels than `most` rows allow, per_class is lowered to
    most / labels. At most 4 * per_class keys a label remain in any case, those with the least
    hashes. Labels must be few: their counts come to the driver.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    per_class = per_class if most is None else max(1, min(per_class, most // max(1, len(counts))))
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(rate)
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < rate).distinct().orderBy(unit, key, label).limit(4 * per_class * max(1, len(counts))), counts


def one_text_each(rows: DataFrame, text: str = "text") -> DataFrame:
    """Of rows that differ in their text only, the one whose text has the least hash."""
    others = [c for c in rows.columns if c != text]
    least = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("v")))
    return rows.groupBy(*others).agg(least.alias("_least")).select(*[F.col("_least.v").alias(text) if c == text else F.col(c) for c in rows.columns])


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over batches: fn gets a dict of Python lists or arrays and returns one."""
    from pyspark.sql.types import StructType

    arrow = _arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict(fn(batch), schema=arrow)

    return df.mapInArrow(run, schema)


def slices(batches, rows: int = 256):
    """The batches in parts of a few rows, so few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list:
    return batch.column(name).to_pylist()


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_platt(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Weighted one-variable logistic regression by Newton's method: slope, intercept."""
    a = b = 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        r = w * (p - y)
        ga, gb = (r * x).sum() + ridge * a, r.sum() + ridge * b
        v = w * p * (1 - p)
        haa, hab, hbb = (v * x * x).sum() + ridge, (v * x).sum(), v.sum() + ridge
        det = haa * hbb - hab * hab
        if det <= 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da) / 5, abs(db) / 5)
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)
