"""K-means with many starts and many numbers of clusters at once.

Every round is one job for all (number of clusters, start) pairs: a task assigns its rows to the centres of each pair and
sends sums per centre, which Spark adds up; the driver holds centres only. Equal rows are counted
once with their number, before anything else.

Starts are drawn by squared distance: of the rows, weighted by their number and their squared distance to the
centres so far, a few candidates are drawn for each start, and the one that lowers the total most is taken. A draw is
a race: each row waits for -ln(u) / weight, with u from a hash of the row, the start and the pick, and the shortest
wait wins. So a draw is a minimum, and does not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areastats.sources import materialise

#: A start has settled when no centre moves further than this share of the columns' spread.
SETTLED = 1e-9


@dataclass(frozen=True)
class KMeansFit:
    """Centres of the best start, their total squared distance, and the rounds it took."""

    centres: np.ndarray
    cost: float
    rounds: int

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as Spark's models name it
        return list(self.centres)


def uniform(marks: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit marks."""
    with np.errstate(over="ignore"):
        z = marks.astype(np.uint64)
        for s in salt:
            z = (z + np.uint64(s + 1) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**64 - 1)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def over_rows(rows: DataFrame, width: int, run: Callable, schema: str) -> DataFrame:
    """Run on all rows of a task: run(x, n, marks) gives the columns of `schema`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(-1, width)
                yield pa.RecordBatch.from_pylist(run(x, batch.column(1).to_numpy(), batch.column(2).to_numpy()))

    return rows.select("x", "n", "mark").mapInArrow(task, schema)


def draw(rows: DataFrame, starts: Sequence[np.ndarray], pick: int, tries: int, seed: int) -> list[np.ndarray]:
    """For each start a few candidates for its next centre."""
    width = len(rows.select("x").first().x)

    def race(x, n, marks):
        out = []
        for s, centres in enumerate(starts):
            far = squared(x, centres).min(1) if len(centres) else np.ones(len(x))
            for t in range(tries):
                with np.errstate(divide="ignore"):
                    wait = -np.log(uniform(marks, seed, s, pick, t)) / (n * far)
                best = int(wait.argmin())
                out.append({"s": s, "t": t, "wait": float(wait[best]), "x": x[best].tolist()})
        return out

    found = over_rows(rows, width, race, "s long, t long, wait double, x array<double>").groupBy("s", "t").agg(F.min(F.struct("wait", "x")).alias("b"))
    got = {(r.s, r.t): list(r.b.x) for r in found.collect()}
    return [np.array([got[s, t] for t in range(tries)]) for s in range(len(starts))]


def seeds(rows: DataFrame, k: int, n_init: int, seed: int) -> list[np.ndarray]:
    """`k` centres for each start; the first ones serve smaller numbers of clusters."""
    width = len(rows.select("x").first().x)
    tries = 2 + int(math.log(k))
    starts = [np.zeros((0, width)) for _ in range(n_init)]
    for pick in range(k):
        found = draw(rows, starts, pick, tries if pick else 1, seed)
        if not pick:
            starts = found
            continue

        def totals(x, n, marks, starts=starts, found=found):
            near = [squared(x, centres).min(1) for centres in starts]
            return [
                {"s": s, "t": t, "total": float((n * np.minimum(near[s], far)).sum())}
                for s, tried in enumerate(found)
                for t, far in enumerate(squared(x, tried).T)
            ]

        sums = over_rows(rows, width, totals, "s long, t long, total double").groupBy("s", "t").agg(F.sum("total").alias("total"))
        best = {r.s: r.b.t for r in sums.groupBy("s").agg(F.min(F.struct("total", "t")).alias("b")).collect()}
        starts = [np.vstack([centres, found[s][best[s]]]) for s, centres in enumerate(starts)]
    return starts


def lloyd(rows: DataFrame, centres: dict[tuple[int, int], np.ndarray], spread: float, max_iter: int) -> dict[tuple[int, int], KMeansFit]:
    """Move the centres of all pairs together until they settle; one job a round."""
    pairs = list(centres)
    width = next(iter(centres.values())).shape[1]
    done: dict[tuple[int, int], KMeansFit] = {}
    for step in range(1, max_iter + 1):
        moving = [p for p in pairs if p not in done]
        if not moving:
            break
        now = [centres[p] for p in moving]

        def sums(x, n, marks, now=now):
            out = []
            for j, c in enumerate(now):
                far = squared(x, c)
                at = far.argmin(1)
                cost = np.bincount(at, n * far[np.arange(len(x)), at], len(c))
                parts = [np.bincount(at, n, len(c)), cost, *[np.bincount(at, n * x[:, d], len(c)) for d in range(width)]]
                out.append({"j": j, "v": np.concatenate(parts).tolist()})
            return out

        each = over_rows(rows, width, sums, "j long, v array<double>").select("j", F.posexplode("v").alias("i", "v"))
        found: dict[int, dict[int, float]] = {}
        for r in each.groupBy("j", "i").agg(F.sum("v").alias("v")).collect():
            found.setdefault(r.j, {})[r.i] = r.v
        for j, pair in enumerate(moving):
            k = len(now[j])
            table = np.array([found[j][i] for i in range(k * (width + 2))]).reshape(width + 2, k)
            n = table[0]
            new = np.where(n[:, None] > 0, table[2:].T / np.maximum(n, 1)[:, None], now[j])  # an empty cluster stays
            centres[pair] = new
            if np.abs(new - now[j]).max() <= SETTLED * spread or step == max_iter:
                done[pair] = KMeansFit(new, float(table[1].sum()), step)
    return done


def best_fits(df: DataFrame, cols: Sequence[str], ks: Sequence[int], n_init: int, seed: int, max_iter: int) -> dict[int, KMeansFit]:
    """For each number of clusters the best of `n_init` starts; the first of equals."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    whole = F.when(F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.raise_error(F.lit("a missing value in a column to cluster by"))).otherwise(x)
    rows = df.select(whole.alias("x")).groupBy("x").agg(F.count("*").cast("double").alias("n"))
    rows = materialise(rows.withColumn("mark", F.xxhash64("x")), "cluster-rows")
    ends = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg((F.max("v") - F.min("v")).alias("w")).collect()
    if not ends:
        raise ValueError("no rows to cluster")
    first = seeds(rows, max(ks), n_init, seed)
    fits = lloyd(rows, {(k, s): c[:k].copy() for k in ks for s, c in enumerate(first)}, max(r.w for r in ends) or 1.0, max_iter)
    return {k: min((fits[k, s] for s in range(n_init)), key=lambda f: f.cost) for k in ks}
