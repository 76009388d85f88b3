"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric on sets, and single shingles are points of it: a set is at
distance 1 - 1/n from each of its n shingles and at distance 1 from any other. Single shingles
are the first pivots. A set lives in the Voronoi region of its first shingle in one
fixed order (all its own shingles are equally near; the order breaks the tie). Sets linked at similarity
t differ in at most (1 - t)/(1 + t) of their joint size, so the region where a set's neighbour
lives is that of one of its first n - ceil(t n) + 1 shingles: these are the regions on whose
boundary it stands, and it is replicated to them and no others. Whole documents cannot
serve as first pivots: unrelated texts are all at distance 1 from them, so no window
would keep any document out of any region.

Inside a region a document becomes the pivot: the member with the fewest shingles ahead of the
region's own (in a group of near copies, the original). Regions with one pivot are joined as
one. Every member is compared with the pivot; members linked to it form its cell and need no comparison
among themselves. The members outside the cell are joined with all members again, where pairs
whose distances to the pivot differ by more than 1 - t cannot link (triangle inequality) and are left out.
Links inside a cell are implied, so only documents outside a cell cost more than one
comparison each; regions are dealt out in groups and squares of groups, so that no task holds a
region. The classes are exact.

Before texts are read for a region, its members are sifted by their sizes and signatures (parities of
slots, as many as shingles, which bound from below how many shingles differ): a member stays if the bound lets it
link with the pivot or with any other member. Only the texts of those that stay are shuffled.

The order puts shingles common in the corpus last (counts of all shingles, hashed to 2^24
counters, on a scale of logarithms in one byte). It decides only how large regions get, never the
result. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areastats.llm.common import SEPARATORS, Scratch, byte_words, components

WIDTH = 5
COUNTER_BITS = 24
CHUNKS = 32
NEEDED_BITS = 24
#: Sets that one task compares with as many others.
GROUP = 256

_RNG = np.random.default_rng(20240607)
_ODD = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words is one shingle."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * _ODD[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _pass_one(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (its set's name and size), and rows with parts of the counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("sig", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())]
        )
        counters, pending, held = np.zeros(1 << COUNTER_BITS, np.uint8), [], 0

        def count():
            some, times = np.unique(np.concatenate(pending), return_counts=True)
            counters[some] = np.minimum(counters[some] + times, 255)

        for batch in batches:
            n, a, signs = [], [], []
            for body in batch.column(1):
                s = shingles(body.as_py(), width)
                n.append(len(s))
                a.append(fingerprint(s))
                signs.append(signature(s) if len(s) else None)
                pending.append(buckets(s))
                held += len(s)
                if held > 500_000:
                    count()
                    pending, held = [], 0
            none = pa.nulls(len(n))
            own = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*own, none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if pending:
            count()
        parts = counters.reshape(CHUNKS, -1)
        pack = zstandard.ZstdCompressor(level=1)
        some = [i for i in range(CHUNKS) if parts[i].any()]
        none = pa.nulls(len(some)).cast(pa.int64())
        packed = pa.array([pack.compress(parts[i].tobytes()) for i in some], pa.binary())
        columns = [none, none, none, pa.nulls(len(some), pa.list_(pa.int64())), pa.array(some, pa.int32()), packed]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, a long, sig array<long>, chunk int, counts binary")


def _counters(parts: DataFrame) -> np.ndarray:
    """Summed counters: 2^24 bytes, whatever the input.

    A byte holds eight times the binary logarithm of the sum. A part, which counts one task's
    rows, stops at 255, so a very common shingle is counted too low, but still as common.
    """

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros((1 << COUNTER_BITS) // CHUNKS, np.uint64), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(unpack.decompress(x.as_py()), np.uint8)
        total = np.minimum(np.round(8 * np.log2(1.0 + total)), 255).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total], pa.binary())], ["chunk", "counts"])

    summed = parts.groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros((CHUNKS, (1 << COUNTER_BITS) // CHUNKS), np.uint8)
    for row in summed.toLocalIterator():
        out[row.chunk] = np.frombuffer(row.counts, np.uint8)
    return out.reshape(-1)


def prefix(s: np.ndarray, counters: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of the regions that a set stands in, in the fixed order."""
    p = len(s) - -(-num * len(s) // den) + 1
    rank = counters[buckets(s)]
    return s[np.lexsort((s, rank))[:p]]


def _memberships(docs: DataFrame, counters, width: int, num: int, den: int) -> DataFrame:
    """A row per set and region: shingle s, set a, m = place of s in the set's order << 32 | size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = counters.value, set()
        schema = pa.schema([("s", pa.int64()), ("a", pa.int64()), ("m", pa.int64())])

        def flush(rows):
            s = np.concatenate([r[0] for r in rows]).view(np.int64)
            a = np.repeat([r[1] for r in rows], [len(r[0]) for r in rows])
            m = np.concatenate([(np.arange(len(r[0])) << 32) | r[2] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array(s), pa.array(a, pa.int64()), pa.array(m, pa.int64())], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for body in batch.column(0):
                s = shingles(body.as_py(), width)
                if not len(s) or (a := fingerprint(s)) in seen:
                    continue
                seen.add(a)
                rows.append((prefix(s, common, num, den), a, len(s)))
                held += len(rows[-1][0])
                if held > 200_000:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return docs.mapInArrow(run, "s long, a long, m long")


def _needed(names: DataFrame) -> np.ndarray:
    """Bitmap of 2^24 bits over set names: a first sieve for the sets to fetch.

    Each task gives the parts it has set; parts are joined by their number, so the driver gets `CHUNKS` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << NEEDED_BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy() & ((1 << NEEDED_BITS) - 1)] = True
        parts, pack = bits.reshape(CHUNKS, -1), zstandard.ZstdCompressor(level=1)
        some = [i for i in range(CHUNKS) if parts[i].any()]
        packed = pa.array([pack.compress(np.packbits(parts[i]).tobytes()) for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), packed], ["chunk", "bits"])

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, unpack = np.zeros((1 << NEEDED_BITS) // 8 // CHUNKS, np.uint8), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column("bits"):
                out |= np.frombuffer(unpack.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["chunk", "bits"])

    schema = "chunk int, bits binary"
    out = np.zeros((CHUNKS, (1 << NEEDED_BITS) // 8 // CHUNKS), np.uint8)
    for row in names.mapInArrow(run, schema).groupBy("chunk").applyInArrow(join, schema).toLocalIterator():
        out[row.chunk] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _fetch(docs: DataFrame, bits, width: int) -> DataFrame:
    """Names of the sets in the bitmap, each with a text that has the set: a third of the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, seen = np.frombuffer(bits.value, np.uint8), set()
        pack = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("a", pa.int64()), ("members", pa.binary())])
        for batch in batches:
            names, sets, held = [], [], 0
            for body in batch.column(0):
                text = body.as_py()
                s = shingles(text, width)
                a = fingerprint(s)
                slot = a & ((1 << NEEDED_BITS) - 1)
                if len(s) and a not in seen and sieve[slot >> 3] >> (7 - (slot & 7)) & 1:
                    seen.add(a)
                    names.append(a)
                    sets.append(pack.compress(text.encode("utf-8", "surrogatepass")))
                    held += len(sets[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    names, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "a long, members binary")


def _may_be_near(num: int, den: int) -> str:
    """SQL: the sizes and signatures of a member and its pivot leave room for a link."""
    least = "least(size(sig), size(p_sig))"
    # Both brought to the shorter length, as `fold` does.
    short = "transform(sequence(0, {least} - 1), i -> aggregate(sequence(i, size({c}) - 1, {least}), 0L, (s, k) -> s ^ {c}[k]))"
    brought = lambda c: f"if(size({c}) = {least}, {c}, {short.format(c=c, least=least)})"
    differ = f"aggregate(zip_with({brought('sig')}, {brought('p_sig')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    sizes = f"{den} * least(n, p_n) >= {num} * greatest(n, p_n)"
    return f"{sizes} AND ({den} + {num}) * {differ} <= ({den} - {num}) * (n + p_n)"


def _may_link(m: str, k: str, num: int, den: int) -> str:
    """SQL: two members of a region can reach the overlap that a link needs, by sizes and places.

    In the first region that they share, what each has up to there is not shared but for the
    region's own shingle.
    """
    n, o = f"({m} & 4294967295)", f"({k} & 4294967295)"
    i, j = f"shiftright({m}, 32)", f"shiftright({k}, 32)"
    return f"({den} + {num}) * least({n} - {i}, {o} - {j}) >= {num} * ({n} + {o})"


def _overlaps(one: np.ndarray, many: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of one sorted set with n others, laid end to end."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    return np.bincount(owner[one[at] == many], minlength=n)


def _laid_out(column, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    sets = [shingles(unpack.decompress(x.as_py()).decode("utf-8", "surrogatepass"), width) for x in column]
    sizes = np.array([len(x) for x in sets])
    return sets, sizes, np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by slots: two sets differ in at least as many shingles as slots.

    A power of two of slots, 1,024 or as many as the set has shingles, so that a long text's
    slots tell as much. The signature for half the slots is the exclusive or of both halves.
    """
    slots = 1 << max(10, (len(s) - 1).bit_length())
    odd = np.bincount(((s >> np.uint64(8)) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def fold(signatures: np.ndarray, length: int) -> np.ndarray:
    """Rows of signatures brought to `length` integers, a power-of-two part of theirs."""
    return np.bitwise_xor.reduce(signatures.reshape(len(signatures), -1, length), axis=1)


def _sift(num: int, den: int):
    """For one square of a region: members that sizes, signatures and pivot distances leave a partner."""

    def run(table: pa.Table) -> pa.Table:
        names, outside = table.column("a").to_numpy(), table.column("x").to_numpy(zero_copy_only=False)
        n, d = table.column("n").to_numpy(), table.column("d").to_numpy()
        signs = [np.asarray(x.values.to_numpy()) for x in table.column("sig")]
        width = np.array([len(x) for x in signs])
        xs, ys = np.flatnonzero(outside), np.flatnonzero(~outside)
        keep = np.zeros(len(names), bool)
        alike = [(w, at, np.stack([signs[j] for j in ys[at]])) for w in np.unique(width[ys]) for at in [np.flatnonzero(width[ys] == w)]]
        folded: dict[tuple[int, int], np.ndarray] = {}
        for i in xs:
            differ = np.zeros(len(ys), np.int64)
            for w, at, many in alike:
                least = min(w, width[i])
                if (w, least) not in folded:
                    folded[w, least] = fold(many, least)
                differ[at] = np.bitwise_count(folded[w, least] ^ fold(signs[i][None], least)).sum(1)
            near = (np.abs(d[ys] - d[i]) <= 1 - num / den + 1e-9) & (names[ys] != names[i])
            near &= den * np.minimum(n[ys], n[i]) >= num * np.maximum(n[ys], n[i])
            near &= (den + num) * differ <= (den - num) * (n[ys] + n[i])
            if near.any():
                keep[i] = True
                keep[ys[near]] = True
        return table.filter(pa.array(keep)).select(["p", "gx", "gy", "a", "linked", "d", "x"])

    return run


def _compare_with_pivot(width: int, num: int, den: int):
    """For a pivot and one group of its members: each member's exact distance and whether it is linked."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("a").to_numpy()
        p = int(table.column("p")[0].as_py())
        sets, sizes, flat, owner = _laid_out(table.column("members"), width)
        at = int(np.flatnonzero(names == p)[0])
        common = _overlaps(sets[at], flat, owner, len(sets))
        union = sizes + sizes[at] - common
        keep = np.arange(len(sets)) != at
        columns = [np.full(keep.sum(), p), names[keep], (den * common >= num * union)[keep], (1 - common / union)[keep], sizes[keep]]
        signs = pa.array([signature(x) for x, k in zip(sets, keep) if k], pa.list_(pa.int64()))
        return pa.table([*columns, signs], ["p", "a", "linked", "d", "n", "sig"])

    return run


def _compare_rest(width: int, num: int, den: int):
    """For one square of a region: links of members outside the pivot's cell with others, as a forest."""

    def run(table: pa.Table) -> pa.Table:
        names, outside = table.column("a").to_numpy(), table.column("x").to_numpy(zero_copy_only=False)
        linked, d = table.column("linked").to_numpy(zero_copy_only=False), table.column("d").to_numpy()
        rows_x, rows_y = np.flatnonzero(outside), np.flatnonzero(~outside)
        if not len(rows_x) or not len(rows_y):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], ["u", "v"])
        sets, sizes, _, _ = _laid_out(table.column("members"), width)
        flat = np.concatenate([sets[i] for i in rows_y])
        owner = np.repeat(np.arange(len(rows_y)), sizes[rows_y])
        u, v = [], []
        for i in rows_x:
            # Triangle inequality: distances to the pivot of linked sets differ by 1 - t at most.
            near = (np.abs(d[rows_y] - d[i]) <= 1 - num / den + 1e-9) & (names[rows_y] != names[i])
            near &= (den * np.minimum(sizes[rows_y], sizes[i]) >= num * np.maximum(sizes[rows_y], sizes[i]))
            if not near.any():
                continue
            common = _overlaps(sets[i], flat, owner, len(rows_y))
            found = np.flatnonzero(near & (den * common >= num * (sizes[rows_y] + sizes[i] - common)))
            # Members of the cell hang together by the pivot: one link to them will do.
            cell = found[linked[rows_y[found]]][:1]
            for j in np.concatenate([cell, found[~linked[rows_y[found]]]]):
                u.append(names[i])
                v.append(names[rows_y[j]])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def jaccard_classes(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, num: int = 75, den: int = 100
) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links).

    Two documents link if den * intersection >= num * union. Documents without words link with
    nothing. A document without a key belongs to its class, named by the smallest key in it
    (NULL if there is none). Repeated rows are copies of each other; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(text).alias("_text"))
    first = scratch.store(_pass_one(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)), width), "sets")
    named = first.where("chunk IS NULL").select("doc_id", "n", "a")
    counters = spark.sparkContext.broadcast(_counters(first.where("chunk IS NOT NULL").select("chunk", "counts")))

    # Regions with two different sets at least. Many regions of a group of near copies have the
    # same pivot; they are joined as one region, the union of their members.
    region = Window.partitionBy("s")
    rows = _memberships(texts, counters, width, num, den)
    figures = {"p": F.min(F.struct("m", "a")), "low": F.min("a"), "high": F.max("a"), "k": F.count("*")}
    rows = rows.withColumns({name: figure.over(region) for name, figure in figures.items()})
    # In a region of two, sizes and places tell whether they can link at all.
    rows = rows.where(f"low <> high AND a <> p.a AND (k > 2 OR {_may_link('m', 'p.m', num, den)})")
    rows = rows.select(F.col("p.a").alias("p"), "a").distinct()
    rows = scratch.store(rows, "regions")

    group = lambda c, k: F.pmod(F.xxhash64(c), F.ceil(F.col(k) / GROUP)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.ceil(F.col(k) / GROUP).cast("int") - 1))
    tile = ["p", "gx", "gy"]

    def squares(regions: DataFrame) -> DataFrame:
        """Members not `linked`, against all members of their region that are left a partner by sizes,
        signatures and pivot distances, in squares of groups."""
        open_ = regions.groupBy("p").agg(F.count("*").alias("k"), F.count_if(~F.col("linked")).alias("o")).where("o > 0 AND k > 1")
        left = regions.join(open_, "p")
        kept = ["p", "a", "linked", "d", "n", "sig"]
        xs = left.where("NOT linked").select(*kept, F.lit(True).alias("x"), group("a", "o").alias("gx"), every("k").alias("gy"))
        ys = left.select(*kept, F.lit(False).alias("x"), every("o").alias("gx"), group("a", "k").alias("gy"))
        return xs.unionByName(ys).groupBy(*tile).applyInArrow(
            _sift(num, den), "p long, gx int, gy int, a long, linked boolean, d double, x boolean"
        )

    # Members that sizes and signatures leave a partner in their region, before any text is read.
    signs = first.where("n > 0").groupBy("a").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    pivot = signs.withColumnsRenamed({"a": "p", "n": "p_n", "sig": "p_sig"})
    signed = rows.join(signs, "a").join(pivot, "p")
    signed = signed.select("p", "a", F.expr(_may_be_near(num, den)).alias("linked"), F.lit(0.0).alias("d"), "n", "sig")
    signed = scratch.store(signed, "signed")
    rows = signed.where("linked").select("p", "a").unionByName(squares(signed).select("p", "a")).distinct()
    rows = scratch.store(rows, "candidates")

    # The sets of all members, each once.
    members = rows.select(F.explode(F.array("p", "a")).alias("a"))
    bits = spark.sparkContext.broadcast(_needed(members))
    sets = scratch.store(_fetch(texts, bits, width).groupBy("a").agg(F.first("members").alias("members")), "members")

    # Every member against its pivot, in groups that hold the pivot and at most some hundred members.
    sizes = rows.groupBy("p").agg(F.count("*").alias("k"))
    starred = rows.join(sizes, "p").select("p", "a", group("a", "k").alias("g"))
    pivots = starred.select("p", F.col("p").alias("a"), "g").distinct()
    starred = starred.unionByName(pivots).join(sets, "a").groupBy("p", "g")
    checked = scratch.store(starred.applyInArrow(_compare_with_pivot(width, num, den), "p long, a long, linked boolean, d double, n long, sig array<long>"), "checked")

    # What is left of each region: members outside the cell, against all its members, in squares of groups.
    rest = scratch.store(squares(checked), "sifted").join(sets, "a").groupBy(*tile).applyInArrow(_compare_rest(width, num, den), "u long, v long")
    edges = checked.where("linked").select(F.col("p").alias("x"), F.col("a").alias("y")).unionByName(
        rest.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    reach = components(edges, "x", "y")
    named_sets = named.where("n > 0").groupBy("a").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    named_sets = named_sets.join(reach.withColumnRenamed("node", "a"), "a", "left")
    smallest = named_sets.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    # Only sets with copies or links need a look; any other document is a class of its own.
    classes = (
        named_sets.where("copies > 1 OR component IS NOT NULL")
        .join(smallest, "component", "left")
        .select("a", F.coalesce("least", "rep").alias("class"))
    )
    return named.join(classes, "a", "left").select(
        F.col("doc_id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class of near-duplicates, with the given columns: the one with the smallest key, a NULL key last.

    Rows are told apart by 128-bit hashes of their own, not by keys: texts that share a key are judged each for
    itself, and a class without any key keeps a row too. Of rows with the same key in one class the hash of all columns
    decides. A row without words is a class of its own; rows equal in all columns are one.
    """
    given = [*docs.columns, *[F.col(c).isNull() for c in docs.columns]]
    row = F.struct(F.xxhash64(*given).alias("h1"), F.xxhash64(F.lit("row"), *given).alias("h2"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    blank = F.trim(F.coalesce("text", F.lit("")), F.lit(SEPARATORS)) == ""
    named = rows.select(F.when(blank, F.col("row.h1")).otherwise(F.xxhash64("text")).alias("name"), "row", "key", "text")
    classes = jaccard_classes(named.select("name", "text"), key="name")
    classes = classes.select("name", F.col("component_id").alias("class")).distinct()
    # Minima that tasks combine before the shuffle: of each text, then of each class.
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row")).alias("first")
    kept = named.groupBy("name").agg(first).join(classes, "name").groupBy("class").agg(F.min("first").alias("first"))
    whole = rows.join(kept.select("first.row"), "row").dropDuplicates(["row"])
    return whole.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir):
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def classes_sql(source: str) -> str:
    """SQL with the same result for the documents in `source` (common table expressions, all pairs that share a shingle)."""
    return rf"""
jw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source}),
js AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM jw WHERE len(w) > 0)
), jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jl AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM js p JOIN js q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL
  ) z JOIN jn x ON x.doc_id = z.a JOIN jn y ON y.doc_id = z.b WHERE 100 * c >= 75 * (x.n + y.n - c)
), jr AS (SELECT doc_id AS a, doc_id AS c FROM {source} UNION SELECT jl.b, jr.c FROM jr JOIN jl ON jr.a = jl.a),
jc AS (SELECT a AS doc_id, min(c) AS component_id FROM jr GROUP BY a)"""


ORACLE = f"""WITH RECURSIVE {classes_sql("documents")}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM jc LEFT JOIN jn USING (doc_id)"""
