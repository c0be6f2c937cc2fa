"""SimHash near-duplicates found by covering locality-sensitive hashing.

Each of the 64 bit positions gets a seeded vector of radius + 1 bits. Every non-zero vector v
gives one table, whose mask keeps the positions with an odd inner product with v. The vectors
of at most `radius` differing positions span less than the whole space, so some v is
orthogonal to all of them: in that table the two fingerprints agree on every kept bit. Each
pair within the radius therefore collides in some table, always and not just likely.

Equal fingerprints are folded first. Within a bucket, a forest that joins its linked
fingerprints is emitted, never all pairs. Buckets above `bucket_rows` are dealt over a
triangular grid of chunk pairs, so no task holds an unbounded bucket and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import by_keys, drop_materialised, materialise, slices, texts

SEED = 42
STEP = 1 << 14
TASK_ROWS = 1_000_000  # rows of (table, bucket, fingerprint) that one task sorts, so tasks grow with the data


def fingerprint(text: str | None, width: int = 4) -> int:
    """64 majority bits over the XXH64 of all word shingles; zero without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        span = zip(starts[at : at + STEP][: n - at].tolist(), ends[at : at + STEP].tolist(), strict=True)
        h = np.array([digest(data[i:j], SEED) for i, j in span], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def masks(radius: int, seed: int = 5) -> list[int]:
    """The 2 ** (radius + 1) - 1 covering masks, each as a 64-bit integer."""
    rng = np.random.default_rng(seed)
    own = rng.permutation(np.arange(64) % ((1 << (radius + 1)) - 1) + 1)
    return [sum(1 << b for b in range(64) if bin(int(own[b]) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over fingerprints; the smallest of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, top)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))


def link(bucket: np.ndarray, radius: int, forest: Forest, other: np.ndarray | None = None) -> None:
    """Join all fingerprints of a bucket within the radius, or those across two chunks."""
    bucket = np.sort(bucket) if other is None else bucket  # so x < y below sees every pair of later blocks too
    left = bucket if other is None else other
    for i in range(0, len(bucket), 512):
        a = bucket[i : i + 512]
        for j in range(i if other is None else 0, len(left), 4096):
            near = np.argwhere(np.bitwise_count(a[:, None] ^ left[None, j : j + 4096]) <= radius)
            x, y = a[near[:, 0]], left[j + near[:, 1]]
            keep = x < y if other is None else x != y
            for p, q in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                forest.join(p, q)


def _bucket_edges(radius: int):
    """Over rows (bucket, fp, side) sorted by bucket: star edges of the partition's forest."""

    def close(forest, parts):
        whole = np.concatenate([p[0] for p in parts]) if len(parts) > 1 else parts[0][0]
        side = np.concatenate([p[1] for p in parts]) if len(parts) > 1 else parts[0][1]
        if side.any():
            link(whole[side == 1], radius, forest, whole[side == 2])
        elif len(whole) > 1:
            link(whole, radius, forest)

    def run(batches):
        forest, last, parts = Forest(), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, g = (batch.column(c).to_numpy() for c in ("t", "k", "g"))
            fp, side = batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy()
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (g[1:] != g[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(t)]))
            same = last == (t[0], k[0], g[0])
            if parts and not same:
                close(forest, parts)
                parts = []
            if len(starts) > 1:
                if parts:
                    close(forest, [*parts, (fp[: ends[0]], side[: ends[0]])])
                first = 1 if parts else 0
                for i in np.flatnonzero((ends - starts)[first:-1] > 1) + first:
                    close(forest, [(fp[starts[i] : ends[i]], side[starts[i] : ends[i]])])
                parts = []
            parts.append((fp[starts[-1] :].copy(), side[starts[-1] :].copy()))
            last = (t[-1], k[-1], g[-1])
        if parts:
            close(forest, parts)
        nodes = [x for x in list(forest.up) if forest.root(x) != x]
        for at in range(0, len(nodes), 1 << 16):
            part = nodes[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({
                "u": np.array(part, np.uint64).view(np.int64),
                "v": np.array([forest.root(x) for x in part], np.uint64).view(np.int64),
            })

    return run


def candidate_edges(prints: DataFrame, radius: int, bucket_rows: int = 4096) -> DataFrame:
    """Edges u, v that connect all distinct fingerprints `fp` within the radius."""
    spark = prints.sparkSession
    keys = [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks(radius)]
    keyed = prints.select("fp", F.posexplode(F.array(*keys)).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"))
    hot = materialise(sizes.where(F.col("n") > bucket_rows).select(F.col("t").alias("ht"), F.col("k").alias("hk"), F.ceil(F.col("n") / (bucket_rows // 2)).cast("int").alias("c")))
    if hot.isEmpty():
        dealt = keyed.select("t", "k", F.lit(0).alias("g"), "fp", F.lit(0).alias("side"))
    else:
        c, own = F.coalesce("c", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("c", F.lit(1))).cast("int")
        cell = F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.struct((F.least(own, j) * c + F.greatest(own, j)).alias("g"), F.when(j == own, 0).when(own < j, 1).otherwise(2).alias("side")))
        dealt = keyed.join(hot, (F.col("t") == F.col("ht")) & (F.col("k") == F.col("hk")), "left").select("t", "k", "fp", F.explode(cell).alias("x")).select("t", "k", F.col("x.g").alias("g"), "fp", F.col("x.side").alias("side"))
    rows = prints.count() * len(keys)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return dealt.repartition(parts, "t", "k", "g").sortWithinPartitions("t", "k", "g").mapInArrow(_bucket_edges(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable, as a signed integer) of every node with an edge.

    Alternates large-star and small-star steps until the edges form stars; each round is cut
    off by a written table, and only two numbers a round reach the driver.
    """
    def orient(e):
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()

    def seal(e):
        e = materialise(e)
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return e, (r["n"], r["s"])

    now, mark = seal(orient(edges))
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = orient(both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(low, F.col("u") == F.col("w"))
        small = orient(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))))
        old, before = now, mark
        now, mark = seal(small)
        drop_materialised(old)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """key, by default doc_id as a long, and fp, the fingerprint as a signed 64-bit integer, of every row."""
    rows = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("key"), "text")

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(fp)], names=["key", "fp"])

    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("fp", LongType())]))


def near_duplicates(docs: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of docs.

    doc_id is a whole number (long). component_id is the smallest doc_id reachable over links
    of at most `radius` differing bits. Null and wordless texts share the fingerprint zero and
    are linked like others. Repeated rows each get a row. A null doc_id is in its component but
    never names it: a component of null ids only has a null component_id. An empty table gives
    none. Other columns are left out.
    """
    own = materialise(fingerprints(docs))
    found = assign_components(own, radius, bucket_rows)
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """docs, all columns as they are, with one row of each component of near-duplicates.

    It is the row with the smallest doc_id, null ids last; of rows that share an id, the one
    whose text has the smallest hash. Of rows equal in id and text one stays, whichever. So
    every component keeps exactly one row, whatever ids are null or repeated. Null and wordless
    texts are one component. doc_id is a whole number (long).
    """
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    own = materialise(fingerprints(docs, key))
    found = assign_components(own, radius, bucket_rows)
    gone = found.where(~F.col("key").eqNullSafe(F.col("least"))).select("key.i", "key.h")
    on = {"i": docs["doc_id"].cast("long"), "h": F.xxhash64(docs["text"])}
    out = by_keys(docs, gone, on, "left_anti")
    again = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key.i", "key.h")
    again = materialise(again)
    drop_materialised(own)
    if again.isEmpty():
        return out
    on = {"i": out["doc_id"].cast("long"), "h": F.xxhash64(out["text"])}
    return by_keys(out, again, on, "left_anti").unionByName(by_keys(out, again, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def assign_components(own: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """own (key, fp) with `least`, the smallest key of each row's component."""
    prints = materialise(own.groupBy("fp").agg(F.min("key").alias("least")))
    tree = components(candidate_edges(prints.select("fp"), radius, bucket_rows))
    linked = prints.join(tree, F.col("fp") == F.col("node"))
    head = linked.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "head")
    named = linked.select("fp", "root").join(head, F.col("root") == F.col("head")).select(F.col("fp").alias("f"), "component")
    named = prints.join(named, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "least").alias("least"))
    named = materialise(named)  # so that both sides of the join below come straight from a shuffle and a hot fingerprint can be split
    drop_materialised(prints)
    drop_materialised(tree)
    return own.join(named, F.col("fp") == F.col("f"), "left").select("key", "fp", "least")
