"""Near-duplicate vectors by a subspace pigeonhole join.

Vectors of length 1 with cosine c are at squared distance 2 - 2c. A seeded rotation spreads what
they differ in over all dimensions; the rotated vector is split into blocks of few dimensions. If two vectors are
within the threshold, then in at least one block their squared distance is within the block's
share of the budget, proportional to its dimensions. Each block is range-joined alone: a
vector lives in a grid cell over the first dimensions of the block, and visits the smaller
neighbouring cells that its radius reaches; a pair meets in the smaller of its two cells. Within a cell, pairs inside the
block's budget are candidates, and a candidate is verified exactly, by the cosine of the given
vectors in double precision, in the first block whose budget it meets: the union over the
blocks holds each pair once.

Equal vectors are joined once and counted. The vectors are moved and written once, ordered by label, in chunks of bounded
size. Two chunks with a label in common meet in one task, which puts both into cells and joins these: cells and visits
are never written, so disk grows with the vectors, however full the cells are, and a label's pairs of chunks are dealt to
all tasks. A task returns each vector's number of links and a spanning
forest of the links, not the pairs, so results grow with vectors, whatever the groups of copies.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import Scratch, components

BLOCK_DIMS = 16
GRID_DIMS = 2
SEED = 11
#: Vectors of a chunk, and chunks that a task holds ready.
CHUNK = 4096
HELD = 24
#: Rows and columns of the products that look for candidates.
TILE = (512, 1024)
SLACK = 1e-9
#: More than what single precision loses in a squared distance of unit vectors.
ROUGH = 1e-5


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def turn(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; a row's result does not depend on the rows beside it."""
    scaled = x / np.abs(x).max(1, keepdims=True)
    unit = scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return np.einsum("ij,kj->ik", unit, rotation(x.shape[1]))


def blocks(dims: int) -> list[slice]:
    return [slice(i, min(i + BLOCK_DIMS, dims)) for i in range(0, dims, BLOCK_DIMS)]


def cells(part: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, at home) for the rows of one block: their cells (two radii wide), and smaller cells within their radius."""
    from itertools import product

    g = min(GRID_DIMS, part.shape[1])
    scaled = part[:, :g] / (2 * radius)
    home = np.floor(scaled).astype(np.int64)
    frac = scaled - home
    yield np.arange(len(part)), home, True
    slack = 1 + 1e-6
    for step in product((-1, 0, 1), repeat=g):
        if step >= (0,) * g:
            continue
        reach = np.zeros(len(part))
        for j, s in enumerate(step):
            reach += (frac[:, j] if s < 0 else 1 - frac[:, j] if s > 0 else 0.0) ** 2
        at = np.flatnonzero(reach <= slack / 4)
        yield at, home[at] + np.array(step), False


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a batch as one, so that the copies of one vector do not all move to the same task."""
    for batch in batches:
        same, ids = batch["same"].to_numpy(), batch["id"].to_numpy()
        if not len(same):
            continue
        _, first, group, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        least = ids[first]
        np.minimum.at(least, group, ids)
        vectors = batch["vector"].take(pa.array(first))
        lengths = vectors.value_lengths().to_numpy()
        raw = memoryview(np.ascontiguousarray(vectors.flatten().to_numpy())).cast("B")
        width = vectors.type.value_type.bit_width // 8
        ends = np.append(0, np.cumsum(lengths, dtype=np.int64)) * width
        packed = pa.array([raw[lo:hi] for lo, hi in zip(ends, ends[1:])], pa.binary())
        columns = [pa.array(lengths, pa.int32()), batch["label"].take(pa.array(first)), pa.array(same[first]), pa.array(least), pa.array(n, pa.int64()), packed]
        yield pa.RecordBatch.from_arrays(columns, ["dims", "label", "rep", "id", "n", "vector"])


def _merged(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ordered rows with copies of a vector added up."""
    new = np.append(True, (rows["rep"][1:] != rows["rep"][:-1]) | (rows["label"][1:] != rows["label"][:-1]) | (rows["dims"][1:] != rows["dims"][:-1]))
    first = np.flatnonzero(new)
    sums = {"id": np.minimum.reduceat(rows["id"], first), "n": np.add.reduceat(rows["n"], first)}
    return {name: v[first] for name, v in rows.items()} | sums


def _chunks(size: int):
    """Function for rows in order: chunks of one number of dimensions and at most `size` vectors."""

    def packed(rows: dict[str, np.ndarray], no: int) -> pa.RecordBatch:
        whole = [no, int(rows["dims"][0]), int(rows["label"][0]), int(rows["label"][-1])]
        flat = [rows[name].tobytes() for name in ("label", "rep", "id", "n")] + [b"".join(rows["vector"])]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], kind) for v, kind in zip(whole, kinds)] + [pa.array([v], pa.binary()) for v in flat], ["no", "dims", "low", "high", *MEMBERS]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {name: batch[name].to_numpy(zero_copy_only=False) for name in ("dims", "label", "rep", "id", "n", "vector")}
            held = _merged({name: np.concatenate([held[name], v]) if held else v for name, v in rows.items()})
            # The last chunk may still grow: the dimensions change, or it is full.
            while (end := min(int(np.argmax(held["dims"] != held["dims"][0])) or len(held["dims"]), size)) < len(held["dims"]):
                yield packed({name: v[:end] for name, v in held.items()}, no)
                held, no = {name: v[end:] for name, v in held.items()}, no + 1
        if held:
            yield packed(held, no)

    return run


MEMBERS = ("label", "rep", "id", "n", "vector")
CHUNKS = "no long, dims int, low long, high long, label binary, rep binary, id binary, n binary, vector binary"


@dataclass(frozen=True)
class Chunk:
    """Some vectors, and by block the members of each cell: those at home first, and how many these are."""

    rep: np.ndarray
    n: np.ndarray
    #: As they were given.
    x: np.ndarray
    turned: np.ndarray
    cells: Sequence[dict[tuple, tuple[np.ndarray, int]]]

    @classmethod
    def of(cls, dims: int, label: bytes, rep: bytes, n: bytes, vector: bytes, budget: float) -> Chunk:
        labels = np.frombuffer(label, np.int64)
        x = np.frombuffer(vector, np.dtype(f"f{len(vector) // dims // len(labels)}")).reshape(-1, dims)
        turned, found = turn(x.astype(np.float64)), []
        for where in blocks(dims):
            radius = (budget * (where.stop - where.start) / dims * (1 + SLACK)) ** 0.5
            at, cell, home = zip(*[(at, cell, np.full(len(at), home)) for at, cell, home in cells(turned[:, where], radius)])
            at, cell, home = np.concatenate(at), np.concatenate(cell), np.concatenate(home)
            keys = np.c_[labels[at], cell]
            order = np.lexsort((~home, *keys.T[::-1]))
            at, home, keys = at[order], home[order], keys[order]
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            ends = np.append(starts[1:], len(at))
            homes = np.add.reduceat(home.astype(np.int64), starts)
            found.append({tuple(keys[lo].tolist()): (at[lo:hi], int(h)) for lo, hi, h in zip(starts, ends, homes)})
        return cls(np.frombuffer(rep, np.int64), np.frombuffer(n, np.int64), x, turned, found)


def _candidates(a: Chunk, b: Chunk, block: int, where: slice, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that share a cell, at home in it for one of the two, and may lie within the block's share of the budget."""
    # A product of (p, -p^2 / 2, 1) and (q, 1, -q^2 / 2) is minus half the squared distance.
    p, q = a.turned[:, where], b.turned[:, where]
    one = np.ones((1, 1))
    left = np.c_[p, (p * p).sum(1) / -2, np.broadcast_to(one, (len(p), 1))].astype(np.float32)
    right = np.c_[q, np.broadcast_to(one, (len(q), 1)), (q * q).sum(1) / -2].astype(np.float32)
    least = np.float32(-share / 2 - ROUGH)
    for key in a.cells[block].keys() & b.cells[block].keys():
        (i, i_home), (j, j_home) = a.cells[block][key], b.cells[block][key]
        for u, v in ((i[:i_home], j), (i[i_home:], j[:j_home])):
            for lo in range(0, len(u), TILE[0]):
                us = u[lo : lo + TILE[0]]
                rows = left[us]
                for ro in range(0, len(v), TILE[1]):
                    vs = v[ro : ro + TILE[1]]
                    near = np.flatnonzero(rows @ right[vs].T >= least)
                    if len(near):
                        yield us[near // len(vs)], vs[near % len(vs)]


def _join_chunks(cosine: float, budget: float):
    """Function for pairs of chunks: links of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: OrderedDict[int, Chunk] = OrderedDict()
        # Vectors of the chunks seen by this task: where a chunk begins, names, links, and trees of linked ones.
        begins: dict[int, int] = {}
        rep = degree = parent = np.zeros(0, np.int64)
        forest: list[tuple[int, int]] = []

        def chunk(no: int, side: str, dims: int, value) -> Chunk:
            if no not in ready:
                ready[no] = Chunk.of(dims, *[value(f"{side}_{c}") for c in ("label", "rep", "n", "vector")], budget)
            ready.move_to_end(no)
            while len(ready) > HELD:
                ready.popitem(last=False)
            return ready[no]

        def roots(nodes: np.ndarray) -> np.ndarray:
            while len(nodes) and ((above := parent[nodes]) != nodes).any():
                parent[nodes] = parent[above]
                nodes = above
            return nodes

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for batch in batches:
            for k in range(batch.num_rows):
                value = lambda name: batch.column(name)[k].as_py()  # noqa: B023, E731
                dims, a_no, b_no = value("dims"), value("a_no"), value("b_no")
                a, b = chunk(a_no, "a", dims, value), chunk(b_no, "b", dims, value)
                for no, own in ((a_no, a), (b_no, b)):
                    if no not in begins:
                        begins[no] = len(rep)
                        rep, degree = np.append(rep, own.rep), np.append(degree, np.zeros(len(own.rep), np.int64))
                        parent = np.append(parent, np.arange(begins[no], len(rep)))
                from_a, from_b = begins[a_no], begins[b_no]
                where = blocks(dims)
                shares = [budget * (w.stop - w.start) / dims * (1 + SLACK) for w in where]
                for block in range(len(where)):
                    for i, j in _candidates(a, b, block, where[block], shares[block]):
                        if a is b:
                            i, j = i[i < j], j[i < j]
                        for s in range(0, len(i), 20_000):
                            u, v = i[s : s + 20_000], j[s : s + 20_000]
                            d2 = (a.turned[u] - b.turned[v]) ** 2
                            first = np.full(len(u), -1)
                            for w in range(len(where) - 1, -1, -1):
                                first[d2[:, where[w]].sum(1) <= shares[w]] = w
                            u, v = u[first == block], v[first == block]
                            x, y = a.x[u].astype(np.float64), b.x[v].astype(np.float64)
                            x, y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
                            linked = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
                            u, v = u[linked], v[linked]
                            y, z = from_a + u, from_b + v
                            np.add.at(degree, y, b.n[v])
                            np.add.at(degree, z, a.n[u])
                            apart = roots(y) != roots(z)
                            for y, z in zip(y[apart].tolist(), z[apart].tolist()):
                                ry, rz = root(y), root(z)
                                if ry != rz:
                                    parent[max(ry, rz)] = min(ry, rz)
                                    forest.append((y, z))
        some = np.flatnonzero(degree)
        for lo in range(0, len(some), 20_000):
            at = some[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(degree[at]), pa.nulls(len(at), pa.int64())], ["rep", "links", "other"])
        for lo in range(0, len(forest), 20_000):
            y, z = np.array(forest[lo : lo + 20_000]).T
            yield pa.RecordBatch.from_arrays([pa.array(rep[y]), pa.array(np.zeros(len(y), np.int64)), pa.array(rep[z])], ["rep", "links", "other"])

    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector of the chunks, without its components."""
    for batch in batches:
        for k in range(batch.num_rows):
            flat = [pa.array(np.frombuffer(batch.column(name)[k].as_py(), np.int64)) for name in ("rep", "id", "n")]
            yield pa.RecordBatch.from_arrays(flat, ["rep", "id", "n"])


def link_vectors(
    vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = CHUNK
) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id, kept.

    Vectors are linked if their labels are equal and their cosine is at least `cosine`. A vector that
    is NULL, empty, zero or holds NULL, NaN or infinite components, that has no label, or no key,
    links with nothing, nor do vectors of different dimensions. Rows that repeat a key are vectors of
    their own. A vector without a key is kept and has no component. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    budget = 2 - 2 * cosine
    # Single precision moves as such; all figures are in double precision.
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast(kind).alias("vector"),
    ).withColumn(
        "valid",
        F.coalesce(
            F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0),
            F.lit(False),
        ),
    )
    # Equal vectors are one; it goes by a hash of its label and components, in which rows may repeat an id.
    valid = rows.where("valid").withColumn("same", F.xxhash64("label", F.col("vector").cast("array<double>")))
    reps = valid.select("label", "same", "id", "vector").mapInArrow(_distinct, "dims int, label long, rep long, id long, n long, vector binary")
    reps = reps.repartitionByRange("dims", "label", "rep").sortWithinPartitions("dims", "label", "rep")
    chunks = scratch.store(reps.mapInArrow(_chunks(chunk), CHUNKS), "chunks")

    # Whichever side is small is sent to all; else each task reads its two shares of the written chunks.
    side = lambda s: chunks.select(*[F.col(c).alias(f"{s}_{c}") for c in chunks.columns if c != "id"])
    meet = side("a").join(
        side("b"), F.expr("a_no <= b_no AND a_low <= b_high AND b_low <= a_high AND a_dims <= b_dims AND b_dims <= a_dims")
    )
    meet = meet.withColumnRenamed("a_dims", "dims").drop("a_low", "a_high", "b_low", "b_high", "b_dims")
    found = scratch.store(meet.mapInArrow(_join_chunks(cosine, budget), "rep long, links long, other long"), "links")
    reps = chunks.select("rep", "id", "n").mapInArrow(_names, "rep long, id long, n long")

    degree = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(found.where("other IS NOT NULL"), "rep", "other")
    named = reps.select("rep", "id", "n").join(degree, "rep", "left").join(reach.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select(
        F.col("rep").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    out = valid.select("id", "same").join(named, "same").select("id", "n_links", "component_id")
    alone = rows.where("NOT valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def query(spark, sf_dir):
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q
  ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.93
), r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
