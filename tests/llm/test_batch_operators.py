"""Centroid clustering, line dedup and the filter audit against brute force and on odd rows."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from areastats.llm import centroids, interaction, lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# -- centroid clustering ------------------------------------------------------


def lloyd(rows, k, rounds):
    """Rounds on whole integers, one vector after another."""
    rows = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
    centre = [list(v) for _, v in rows[:k]]
    near = lambda v: min(range(len(centre)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(v, centre[c])), c))
    for _ in range(rounds):
        at = [near(v) for _, v in rows]
        for c in range(len(centre)):
            own = [v for (_, v), a in zip(rows, at) if a == c]
            if own:
                centre[c] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, near(v), sum((a - b) ** 2 for a, b in zip(v, centre[near(v)]))) for i, v in rows), centre


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cluster string, row int, cells int")


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_clusters_against_brute_force(spark, bits):
    rng = np.random.default_rng(2)
    made = np.vstack([rng.normal(0, 0.1, (60, 6)), rng.normal(0.4, 0.2, (60, 6)), np.tile(rng.normal(0, 1, 6), (40, 1))]).astype(np.float32)
    rows = [(i // 2 if i < 150 else None, v.tolist(), 0, "x", 1, 2) for i, v in enumerate(made)]
    odd = [(900, None), (901, []), (902, [0.0] * 5), (903, [None] + [0.0] * 5), (904, [math.nan] * 6), (905, [math.inf] + [0.0] * 5)]
    df = vectors(spark, rows + [(i, v, 0, "x", 1, 2) for i, v in odd]).repartition(3)
    want, centre = lloyd([(r[0], tuple(math.floor(1024 * x) for x in r[1])) for r in rows], 4, 5)
    got = centroids.cluster(df, k=4, rounds=5, dims=6, bits=bits, sample=50)
    assert Counter(tuple(r) for r in got.assigned.collect()) == want and got.centroids == centre
    assert got.inertias == [sum(d * n for (_, c, d), n in want.items() if c == x) for x in range(4)]


def test_clusters_of_few_or_no_vectors(spark):
    assert centroids.cluster(vectors(spark, []), dims=2).assigned.count() == 0
    df = vectors(spark, [(1, [0.5, 0.5], 0, "x", 1, 2), (1, [0.5, 0.5], 0, "x", 1, 2)])
    got = centroids.cluster(df, dims=2)
    assert [tuple(r) for r in got.assigned.collect()] == [(1, 0, 0)] * 2 and got.centroids == [[512, 512]] * 2
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0], 0, "x", 1, 2)]), dims=2)


def test_intervals_never_settle_wrongly():
    rng = np.random.default_rng(4)
    x = rng.integers(-900, 900, (4000, 16))
    x[:50] = x[0]
    for bits in (2, 5, 8):
        cells = centroids.Cells.cut(x[:500], x.min(0), x.max(0), bits)
        codes = cells.codes(x)
        at = np.arange(16)
        assert (cells.low[codes, at] <= x).all() and (x <= cells.high[codes, at]).all()
        for centre in (x[:6], np.repeat(x[60:62], 3, 0)):
            found, exact = cells.settle(codes, centre), centroids.nearest(x, centre)[0]
            assert (exact[found >= 0] == found[found >= 0]).all()
        assert bits < 8 or (found >= 0).mean() > 0.5


# -- line dedup ---------------------------------------------------------------


def lines_by_brute_force(rows, least, docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    held, keeper = Counter(), {}
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n") if len(line.strip(" \t\n\x0b\x0c\r")) >= least}:
            held[k] += 1
            if i is not None:
                keeper[k] = max(i, keeper.get(k, i))
    out = []
    for i, text in rows:
        given = (text or "").split("\n")
        kept = [x for x in given if held[key(x)] < docs or key(x) not in keeper or i == keeper[key(x)]]
        out.append((i, len(given), len(given) - len(kept), "\n".join(kept)))
    return Counter(out)


def line_table(spark, rows):
    full = [(i, t, k, "a", "b") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, n int, row string, drops string")


@pytest.mark.parametrize("batches", [1, 4, 11])
def test_lines_against_brute_force(spark, batches):
    rng = np.random.default_rng(8)
    pool = [f"common line {k} " + "é" * (k % 7) for k in range(30)]
    rows = []
    for i in range(120):
        picked = [pool[int(x)] for x in rng.integers(0, len(pool), rng.integers(0, 6))]
        rows.append((i, "\n".join(["  " + p.upper() if k % 3 == 0 else p + "\t" for k, p in enumerate(picked)] + [f"own {i}"])))
    rows += [(7, rows[7][1]), (119, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (200, None), (201, ""), (202, "\n\n"), (None, None)]
    rows += [(300 + i, "A shared passage\nof lines\n" * 40) for i in range(60)] + [(None, "only without ids\n")] * 6
    got = lines.dedup_lines(line_table(spark, rows).repartition(4), min_chars=9, min_docs=5, batches=batches).collect()
    assert Counter((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.text or "") for r in got) == lines_by_brute_force(rows, 9, 5)
    assert sorted(r.n for r in got) == list(range(len(rows))) and {(r.row, r.drops) for r in got} == {("a", "b")}


def test_lines_of_an_empty_table_and_a_long_text(spark):
    assert lines.dedup_lines(line_table(spark, []).limit(0)).count() == 0
    long = "\n".join(f"{k % 50} is a line of the passage that repeats in all of these texts" for k in range(20000))
    got = {r.doc_id: r.lines.n_dropped for r in lines.dedup_lines(line_table(spark, [(i, long) for i in range(5)])).collect()}
    assert got == {0: 20000, 1: 20000, 2: 20000, 3: 20000, 4: 0}
    with pytest.raises(ValueError):
        lines.dedup_lines(line_table(spark, []), into="n")


def test_runs_stay_few_and_are_removed(spark):
    runs = lines.Runs(spark, buckets=4, fanout=2)
    for i in range(9, 0, -1):
        runs.add(spark.range(i, i + 3).selectExpr("id AS a", "id AS b", "1L AS n", f"{i}L AS last"))
    assert [len(level) for level in runs.levels] == [1, 0, 0, 1]
    got = {r.a: (r.n, r.keeper) for r in runs.frequent(1).collect()}
    assert got == {a: (min(a, 3, 12 - a), min(a, 9)) for a in range(1, 12)}
    runs.close()
    assert not runs.paths


# -- filter audit -------------------------------------------------------------


def audit_by_brute_force(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    masked = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": copy,
        }
        masked.append((i, lang or "", {f for f, x in failed.items() if x}))
    out = {}
    for part in {p for _, p, _ in masked}:
        own = [(i, failed) for i, p, failed in masked if p == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in own if f in x[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in own)]
                out[part, "".join(order), step] += [sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = [(3, 1, 0), (9, 0, 1), (9, 1, 0), (14, None, 1), (None, 1, 1), (21, 1, 1), (30, 1, 0)]


def audit_rows():
    plain = " ".join(f"w{k}" for k in range(250))
    texts = [plain, plain + " A B C" * 30, "x " * 300, "short", "Mark #", None, "", plain + " $"]
    rows = [(k % 33, texts[(k * 5) % len(texts)], ("en", "de", None, "")[k % 4]) for k in range(48)]
    return rows + [(None, plain, "en"), (None, "short", "en"), (0, plain, "fr"), (0, plain, "fr"), (-5, plain, "pt"), (40, "#" * 30000, "pt")]


def as_table(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in FIGURES] for r in df.collect()}


def write_files(spark, rows, path, mode="error"):
    """One file for each slice, largest ids first, so that later files retract what earlier ones counted."""
    rows = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else 10))
    for k in range(0, len(rows), 9):
        part = [(*r, "extra", 1) for r in rows[k : k + 9]]
        spark.createDataFrame(part, "doc_id long, text string, lang string, slot string, mask int").coalesce(1).write.mode("append").parquet(path)


def test_audit_against_brute_force(spark, tmp_path):
    rows = audit_rows()
    write_files(spark, rows, f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = as_table(interaction.audit(spark, f"{tmp_path}/documents.parquet", labels))
    assert got == audit_by_brute_force(rows, LABELS) and len(got) == 600 * 5


def test_audit_goes_on_where_it_stopped(spark, tmp_path):
    rows = audit_rows()
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    path, checkpoint = f"{tmp_path}/documents.parquet", f"{tmp_path}/checkpoint"
    for part in (rows[30:], rows[:30]):
        write_files(spark, part, path)
        counters = interaction.stream_counters(spark, path, labels, checkpoint)
    assert as_table(interaction.interactions(counters)) == audit_by_brute_force(rows, LABELS)


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(spark, f"{tmp_path}/documents.parquet", labels).count() == 0


def test_holders_move_when_smaller_ids_arrive():
    import pandas as pd

    row = lambda i, part: {"h1": 1, "h2": 2, "id": i, "part": part, "mask": 3}
    held = interaction.HELD.empty_table().to_pandas()
    total = Counter()
    for arriving in ([row(7, "a"), row(9, "b")], [row(5, "b"), row(5, "b")], [row(6, "a")], [row(5, "c")]):
        held, changes = interaction.settle(held, pd.DataFrame(arriving))
        for c in changes.itertuples():
            total[c.id, c.part, c.mask] += c.n
    assert +total == Counter({(5, "b", 3): 2, (5, "c", 3): 1, (7, "a", 19): 1, (9, "b", 19): 1, (6, "a", 19): 1})
    assert min(total.values()) >= 0 and sorted(held["part"]) == ["b", "c"]


def test_queries_read_whole_tables(spark, small_data):
    """Every row has its result; the SQL checks hold the values."""
    docs = spark.read.parquet(f"{small_data}/documents.parquet")
    assert lines.query(spark, small_data).count() == docs.count()
    parts = docs.select(F.coalesce("lang", F.lit(""))).distinct().count()
    assert interaction.query(spark, small_data).count() == 600 * parts
