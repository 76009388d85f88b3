"""Centroid clustering (Lloyd's rounds) over a vector-approximation file.

Every vector is kept twice in one table: in full, and as an approximation of few bits for each dimension, the
number of the cell its component lies in. Cells are cut at quantiles of a bounded sample; the outer
ones reach to the true smallest and largest component, so every component lies in its cell.

A round reads the approximations only. Lookup tables (dimension, cell) -> least and most squared difference add up to
an interval of the distance to each centroid. Where the interval of the nearest overlaps others, a
second table, of the difference between two centroids' distances, narrows it: that difference is linear in
the vector, so its interval is much tighter. Vectors that are still open, and vectors that changed
their cluster since the round before, are fetched in full by a join on their number. The table has the
buckets of that join, so full vectors are not shuffled. Sums of clusters are kept, exact integers on the driver (one row a
cluster), and corrected by the vectors that moved. A round keeps no state of its own:
it settles each vector for the former and the present centroids together, so a lost task is only run again.

All arithmetic is on integers. Defined results:
* vectors that are NULL, of another length, or hold a NULL or non-finite component are left out;
* components are floor(scale * x); one of 2^27 or more in size is an error, as distances would not fit a long;
* seeds are the vectors with the smallest hashes of `seed:id` (nothing for a NULL id), ties by id and components;
  with fewer vectors than clusters every vector is a seed; equal centroids: the smaller number takes the vectors;
* repeated rows are vectors of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import Scratch
from areastats.sources.tables import drop_path, scratch_path

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SEED = 3
#: Bits of a component's cell; one byte holds it.
BITS = 8
#: Vectors, about, from which cells are cut.
SAMPLE = 8192
LARGEST = 1 << 27


@dataclass(frozen=True)
class Cells:
    """Smallest and largest value (cells, dims) of every cell, and the cuts between them."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def cut(cls, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS) -> Cells:
        """Cells at quantiles of the sample; equal cuts leave empty cells between them."""
        at = np.arange(1, 1 << bits) / (1 << bits)
        cuts = np.quantile(sample, at, axis=0, method="lower") if len(sample) else np.zeros((len(at), len(least)))
        cuts = np.clip(cuts.astype(np.int64), least, most)
        low, high = np.vstack([least, cuts]), np.vstack([cuts - 1, most])
        return cls(low, np.maximum(low, high))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.low[1:, j], x[:, j], side="right") for j in range(x.shape[1])], 1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """(dims, cells, 2 x clusters): least and most squared difference to each centroid."""
        a, b = self.low[:, :, None] - centroids.T[None], self.high[:, :, None] - centroids.T[None]
        a2, b2 = a * a, b * b
        least = np.where((a <= 0) & (b >= 0), 0, np.minimum(a2, b2))
        return np.ascontiguousarray(np.concatenate([least, np.maximum(a2, b2)], 2).transpose(1, 0, 2))

    def differences(self, centroids: np.ndarray, own: int) -> np.ndarray:
        """(dims, cells, clusters): most that the distance to `own` can exceed that to each centroid."""
        slope = 2 * (centroids - centroids[own])  # of d(x, own) - d(x, c) in x, for each dimension
        shift = centroids[own] ** 2 - centroids**2
        most = np.maximum(self.low[:, :, None] * slope.T[None], self.high[:, :, None] * slope.T[None]) + shift.T[None]
        return np.ascontiguousarray(most.transpose(1, 0, 2))

    def settle(self, codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Nearest centroid of each approximation, -1 where the intervals leave it open."""
        k = len(centroids)
        sums = add_up(self.tables(centroids), codes)
        low, high = sums[:, :k], sums[:, k:]
        best = high.argmin(1)
        wins = lambda gap, c: (gap < 0) | ((gap == 0) & (best <= c))  # noqa: E731  ties go to the smaller number
        alone = np.ones(len(codes), bool)
        for c in range(k):
            alone &= (best == c) | wins(high[np.arange(len(codes)), best] - low[:, c], c)
        # Where intervals overlap, those of differences, against the centroid with the smallest middle.
        best = np.where(alone, best, (low + high).argmin(1))
        for own in range(k):
            at = np.flatnonzero(~alone & (best == own))
            gaps = add_up(self.differences(centroids, own), codes[at])
            alone[at] = ((gaps < 0) | ((gaps == 0) & (own <= np.arange(k))) | (np.arange(k) == own)).all(1)
        return np.where(alone, best, -1)


def add_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum over the dimensions of the table's rows for each vector's cells."""
    out = np.zeros((len(codes), table.shape[2]), np.int64)
    for j in range(codes.shape[1]):
        out += table[j][codes[:, j]]
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance, exactly."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def cells_of(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, dims)


def whole_vectors(vectors: DataFrame, column: str, key: str, dims: int, scale: int) -> DataFrame:
    """(id, vector): the vectors that count, as integers."""
    v = F.col(column)
    length = F.coalesce(F.size(v) == dims, F.lit(False))
    finite = length & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = lambda x: x.cast("double") * scale
    small = F.forall(v, lambda x: F.abs(scaled(x)) < LARGEST)
    message = F.lit(f"a component times {scale} is 2^27 or more: its distances do not fit a long")
    # Each condition holds its own guard: a filter may be evaluated before those beside it.
    whole = F.when(finite & small, F.transform(v, lambda x: F.floor(scaled(x)).cast("int"))).when(finite, F.raise_error(message))
    return vectors.select(F.col(key).alias("id"), whole.alias("vector"), finite.alias("finite")).where("finite").drop("finite")


@dataclass
class Clustering:
    """Result: assigned (id, cluster, distance), and per cluster its centroid and inertia."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertias: list[int]
    #: Share of the vectors fetched in each round.
    fetched: list[float]


def cluster(
    vectors: DataFrame,
    column: str = "embedding",
    key: str = "vec_id",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
    bits: int = BITS,
    sample: int = SAMPLE,
) -> Clustering:
    """Seeds, `rounds` rounds of assigning and moving centroids, and a last assignment."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    base = whole_vectors(vectors, column, key, dims, scale)
    parts = base.select(F.posexplode("vector").alias("j", "x")).groupBy("j")
    span = sorted(parts.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("n")).collect())
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = base.orderBy(digest, "id", "vector").limit(k).collect()
    if not span:
        return Clustering(spark.createDataFrame([], "id long, cluster int, distance long"), [], [], [])
    n = span[0].n
    every = max(1, n // sample)
    fit = base.where(F.pmod(F.xxhash64("id", "vector"), F.lit(every)) == 0).select("vector").toPandas()["vector"]
    fit = np.array(fit.tolist(), np.int64).reshape(-1, dims)
    cells = Cells.cut(fit, np.array([r.least for r in span]), np.array([r.most for r in span]), bits)

    name, index = write_index(base, cells, dims)
    try:
        old = np.array([list(r.vector) for r in seeds], np.int64)
        k = len(old)
        sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
        change(sums, counts, index.select("cells", "vector").mapInArrow(first_sums(cells, old), MOVES))
        new, fetched = moved(old, sums, counts), [1.0]
        for _ in range(rounds - 1):
            if (new == old).all():  # nothing would change in the rounds left
                break
            looks = index.select("row", "cells").mapInArrow(open_or_moved(cells, old, new), "row long")
            looks = scratch.store(looks, "looks")
            fetched.append(looks.count() / n)
            full = index.select("row", "vector").join(looks, "row").select("vector")
            change(sums, counts, full.mapInArrow(moves(old, new, dims), MOVES))
            scratch.drop(looks)
            old, new = new, moved(new, sums, counts)
        assigned = index.select("id", "cells", "vector").mapInArrow(assign(cells, new), "id long, cluster int, distance long")
        assigned = scratch.store(assigned, "clusters")
    finally:
        spark.sql(f"DROP TABLE {name[0]}")
        drop_path(spark, name[1])
    found = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    return Clustering(assigned, new.tolist(), [found.get(c, 0) for c in range(k)], fetched)


def write_index(base: DataFrame, cells: Cells, dims: int) -> tuple[tuple[str, str], DataFrame]:
    """The table of approximations and full vectors, bucketed by a number given to each row."""
    spark = base.sparkSession
    name = f"llm_vectors_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cells.codes(matrix(batch.column(2), dims)) if batch.num_rows else np.zeros((0, dims), np.uint8)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], ["row", "id", "vector", "cells"])

    numbered = base.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long"), "vector")
    coded = numbered.mapInArrow(encode, "row long, id long, vector array<int>, cells binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = coded.repartition(buckets, "row").write.format("parquet").option("path", path)
    writer.bucketBy(buckets, "row").sortBy("row").saveAsTable(name)
    return (name, path), spark.table(name)


#: Changes of one task: for each cluster the vectors that came, less those that went, and their sums.
MOVES = "cluster int, n long, sums array<long>"


def changes(counts: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.arange(len(counts), dtype=np.int32)), pa.array(counts), pa.array(sums.tolist(), pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])


def change(sums: np.ndarray, counts: np.ndarray, parts: DataFrame) -> None:
    """Add the tasks' changes to the sums of the clusters."""
    each = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("j", "x"))
    for row in each.groupBy("cluster", "j").agg(F.sum("x").alias("x")).collect():
        if row.j:
            sums[row.cluster, row.j - 1] += row.x
        else:
            counts[row.cluster] += row.x


def moved(centroids: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Centroids at the floor of their means; those of empty clusters stay."""
    return np.array([s // n if n else c for c, s, n in zip(centroids, sums, counts)]).astype(np.int64)


def first_sums(cells: Cells, centroids: np.ndarray):
    """Sums of all vectors by the cluster of the first round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), dims)
                at = cells.settle(cells_of(batch.column(0), dims), centroids)
                at[at < 0] = nearest(x[at < 0], centroids)[0]
                counts += np.bincount(at, minlength=k)
                np.add.at(sums, at, x)
        yield changes(counts, sums)

    return run


def open_or_moved(cells: Cells, old: np.ndarray, new: np.ndarray):
    """Numbers of the vectors whose clusters the approximations leave open or show to differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = cells_of(batch.column(1), old.shape[1])
                a, b = cells.settle(codes, old), cells.settle(codes, new)
                wanted = pa.array((a < 0) | (b < 0) | (a != b))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(wanted)], ["row"])

    return run


def moves(old: np.ndarray, new: np.ndarray, dims: int):
    """Changes of the clusters' sums by the fetched vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(new)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                a, b = nearest(x, old)[0], nearest(x, new)[0]
                go = a != b
                counts += np.bincount(b[go], minlength=k) - np.bincount(a[go], minlength=k)
                np.add.at(sums, b[go], x[go])
                np.subtract.at(sums, a[go], x[go])
        yield changes(counts, sums)

    return run


def assign(cells: Cells, centroids: np.ndarray):
    """Cluster and exact distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = centroids.shape[1]
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), dims)
                at = cells.settle(cells_of(batch.column(1), dims), centroids)
                at[at < 0] = nearest(x[at < 0], centroids)[0]
                far = ((x - centroids[at]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"])

    return run


def query(spark, sf_dir):
    done = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    rows = [
        (c, inertia, sum(done.inertias), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
        for c, (centroid, inertia) in enumerate(zip(done.centroids, done.inertias))
    ]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(per_cluster), "cluster")


def _oracle() -> str:
    """The rounds, one after another."""
    floor = "CAST(CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END AS BIGINT)"
    near = """SELECT v.r, arg_min(c.cluster, {{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.cluster}}) AS cluster
      FROM v CROSS JOIN c{i} c GROUP BY v.r"""
    steps = [
        f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM e
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMS}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, vec_id, x) - 1 AS INT) AS cluster, x FROM (
  SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, vec_id, x FROM v ORDER BY h, vec_id, x LIMIT {CLUSTERS}))"""
    ]
    for i in range(ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(
            f"m{i} AS (SELECT cluster, pos, {floor} AS m FROM (SELECT cluster, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM v JOIN a{i} USING (r)) GROUP BY ALL)"
        )
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT cluster, list(m ORDER BY pos) AS x FROM m{i} GROUP BY cluster) n ON c.cluster = n.cluster)"
        )
    steps.append(f"a AS MATERIALIZED ({near.format(i=ROUNDS)})")
    steps.append(
        f"""d AS (SELECT vec_id, a.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a USING (r) JOIN c{ROUNDS} c ON a.cluster = c.cluster)"""
    )
    return (
        ", ".join(steps)
        + """ SELECT *, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia FROM d"""
    )


ORACLE = _oracle()
