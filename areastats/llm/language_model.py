"""A hierarchical Pitman-Yor language model that scores whole texts.

A text is its lower-cased words with one space between, and one end sign; the model predicts
it byte by byte. Each context of up to five bytes is a restaurant: its customers are the bytes
that followed it, its tables send one customer each to the parent restaurant, the
context without its oldest byte, and so on to the empty context and the uniform
distribution. Contexts that share their recent bytes share parents, so what is rare in one is
smoothed by what is known of its relatives, and no byte sequence is out of reach. Seating is
sampled by Gibbs sweeps; the predictive probabilities of several seatings are averaged.

How it runs:

1. Documents are read in blocks of bounded size. A block gives its text (compressed), the sequences of six bytes
   that occur in it with their counts in training documents, and its words with theirs.
2. Counts are merged by bucket. A bucket holds all sequences that end alike (the two bytes before the last, and
   the last), so the restaurants of contexts of two bytes and more lie whole in one
   bucket. Restaurants of shorter contexts have at most 65,536 kinds of customers; they are
   summed up by Spark and sampled on the driver between two passes over the buckets.
3. Each block asks its sequences and words of the buckets, and sums up its documents. A bucket that is asked much is
   dealt out by block: each share has a copy of the bucket's model and at most `SHARE_BYTES` of questions, or one
   block's. Counts of such buckets are merged share by share first.

Nothing grows with the corpus on the driver or in one task but the distinct sequences of one bucket.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import Scratch, byte_words

DEPTH = 5  # bytes of the longest context
BLOCK_BYTES = 24_000_000
PART_BYTES = 3_000_000
SHARE_BYTES = 16_000_000  # packed keys of one bucket that go to one task
BURN_IN = 2
SAMPLES = 3
STRENGTH = 0.5
HELD_OUT = 10

NGRAMS, WORDS, TEXTS = 0, 1, 2


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, "<u8"), dtype=np.uint64)


def mask(n: int) -> np.uint64:
    """The last n bytes of a key."""
    return np.uint64((1 << (8 * n)) - 1)


def ngrams(texts: list[bytes]) -> np.ndarray:
    """Keys of the sequences that end at each byte of the texts; a text starts after spaces."""
    pad = b" " * DEPTH
    raw = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    keys = np.zeros(len(raw) - DEPTH, np.uint64)
    for j in range(DEPTH + 1):
        keys <<= np.uint64(8)
        keys |= raw[j : len(raw) - DEPTH + j]
    keep = np.ones(len(keys), bool)
    ends = np.cumsum([len(t) + DEPTH for t in texts])[:-1] - DEPTH
    for j in range(DEPTH):
        keep[ends + j] = False
    return keys[keep]


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, int)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def bucket_of(keys: np.ndarray, kind: int, n: int) -> np.ndarray:
    x = (keys >> np.uint64(8)) & mask(2) if kind == NGRAMS else keys
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


PARTS = "kind int, bucket int, block long, keys binary, counts binary"


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """What each block holds: its documents, sequences and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
        number = TaskContext.get().partitionId() << 32

        def emit(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        def dealt(kind, keys, counts):
            where = bucket_of(keys, kind, buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    rows.append((kind, b, number, squeeze_sorted(keys[at]), squeeze(counts[at].astype("<i8"))))
            return emit(rows) if rows else None

        ids, texts, held = [], [], []
        taught, asked, keys, counts = Counter(), set(), [], []
        waiting, part, size, ends = [], 0, 0, 0

        def close_part():
            nonlocal part
            for train in (True, False):
                some = [t for t, h in zip(texts[waiting[0] :], held[waiting[0] :]) if h != train] if waiting else []
                if some:
                    k, c = np.unique(ngrams(some), return_counts=True)
                    keys.append(k)
                    counts.append(c if train else np.zeros(len(k), np.int64))
            if len(keys) > 8:
                k, c = merge(keys, counts)
                keys[:], counts[:] = [k], [c]
            waiting.clear()
            part = 0

        def close():
            nonlocal number, size
            close_part()
            yield emit([(TEXTS, 0, number, squeeze(np.array(ids, "<i8")) if None not in ids else pickle.dumps(ids), zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))])
            for out in (dealt(NGRAMS, *merge(keys, counts)), dealt(WORDS, *_sorted_words(taught, asked))):
                if out is not None:
                    yield out
            for x in (ids, texts, held, keys, counts, taught, asked):
                x.clear()
            number, size = number + 1, 0

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = byte_words(body.as_py())
                out = is_held(doc_id)
                if not out:
                    taught.update(words)
                asked.update(words)
                text = b" ".join(words) + b"\n"
                if not waiting:
                    waiting.append(len(texts))
                ids.append(doc_id)
                texts.append(text)
                held.append(out)
                part += len(text)
                size += len(text)
                if part > PART_BYTES:
                    close_part()
                if size > BLOCK_BYTES:
                    yield from close()
        if texts:
            yield from close()

    return docs.mapInArrow(run, PARTS)


def _sorted_words(taught: Counter, asked: set) -> tuple[np.ndarray, np.ndarray]:
    words = list(asked)
    keys = hash_words(words)
    return merge([keys], [np.array([taught[w] for w in words], np.int64)])


def is_held(doc_id: int | None) -> bool:
    """Documents that nothing is learned from; one without an id is learned from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def _shares(parts: DataFrame) -> tuple[DataFrame, int]:
    """Into how many shares each bucket's rows are dealt (a row per kind and bucket), and their sum."""
    size = F.sum(F.length("keys") + F.length("counts"))
    shares = parts.groupBy("kind", "bucket").agg(F.ceil(size / SHARE_BYTES).cast("int").alias("shares"))
    rows = [tuple(r) for r in shares.collect()]  # two kinds of as many buckets as stated
    return parts.sparkSession.createDataFrame(rows, "kind int, bucket int, shares int"), sum(r[2] for r in rows)


def _share() -> Column:
    return F.pmod(F.xxhash64("block"), F.col("shares")).cast("int").alias("share")


def _merged(parts: DataFrame, shares: DataFrame, total: int) -> DataFrame:
    """Training counts by kind and bucket, streamed together; first share by share."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for k, c in zip(batch.column("keys"), batch.column("counts")):
                k, c = expand_sorted(k.as_py()), expand(c.as_py(), "<i8")
                keys.append(k[c > 0])
                counts.append(c[c > 0])
                held += len(keys[-1])
                if held > 2_000_000 and len(keys) > 1:
                    k, c = merge(keys, counts)
                    keys, counts, held = [k], [c], 0
        k, c = merge(keys, counts) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        columns = [[key[0].as_py()], [key[1].as_py()], [len(k)], [int(c.sum())], [squeeze_sorted(k)], [squeeze(c)]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["kind", "bucket", "kinds", "total", "keys", "counts"])

    schema = "kind int, bucket int, kinds long, total long, keys binary, counts binary"
    # `shares` has a row per kind and bucket: its size is set by the stated number of buckets.
    dealt = parts.join(F.broadcast(shares), ["kind", "bucket"])
    by = ["kind", "bucket", "share"]
    some = dealt.where("shares > 1").select("kind", "bucket", "keys", "counts", _share()).repartition(total + 1, *by)
    some = some.groupBy(*by).applyInArrow(run, schema).select("kind", "bucket", "keys", "counts")
    rest = dealt.where("shares = 1").select("kind", "bucket", "keys", "counts")
    return rest.unionByName(some).groupBy("kind", "bucket").applyInArrow(run, schema)


# Restaurants ---------------------------------------------------------------------------


class Level:
    """Restaurants of one context length: a row per context and byte."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.contexts, self.of = np.unique(keys >> np.uint64(8), return_inverse=True)

    def totals(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, x, len(self.contexts))

    def predict(self, c: np.ndarray, t: np.ndarray, d: float, parent: np.ndarray) -> np.ndarray:
        """Predictive probability of each row, given its parent's."""
        total, tables = self.totals(c)[self.of], self.totals(t)[self.of]
        return (c - d * t + (STRENGTH + d * tables) * parent) / (STRENGTH + total)


def seat(c: np.ndarray, parent: np.ndarray, tables: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that c customers of each row take when they are seated one after another.

    `tables` is what the rest of each row's restaurant has. The first twenty customers are seated singly; after
    that, a twentieth of those seated at a time, so the steps grow with the logarithm of c.
    """
    t, n = np.minimum(c, 1).astype(np.int64), np.minimum(c, 1).astype(np.int64)
    rows = np.flatnonzero(c > 1)
    while len(rows):
        new = (STRENGTH + d * (tables[rows] + t[rows])) * parent[rows]
        step = np.minimum(np.maximum(n[rows] // 20, 1), c[rows] - n[rows])
        t[rows] += rng.binomial(step, new / (new + np.maximum(n[rows] - d * t[rows], 1e-12)))
        n[rows] += step
        rows = rows[n[rows] < c[rows]]
    return t


def discount(c: np.ndarray) -> tuple[int, int]:
    """Rows with one and with two customers, from which a level's discount is estimated."""
    return int((c == 1).sum()), int((c == 2).sum())


def chain(keys: np.ndarray, shortest: int) -> tuple[list[Level], list[np.ndarray]]:
    """Levels from the longest context to the shortest, and each row's place in the next one."""
    levels, up = [Level(keys)], []
    for length in range(DEPTH - 1, shortest - 1, -1):
        own, place = np.unique(levels[-1].keys & mask(length + 1), return_inverse=True)
        levels.append(Level(own))
        up.append(place)
    return levels, up


def gibbs(levels, up, counts, base, discounts, rng, samples: int):
    """Sweeps over restaurants whose shortest context draws on `base`; yields (customers, tables) per level."""
    c, t = [counts], []
    for i in range(len(levels)):
        t.append(np.ones(len(c[i]), np.int64))
        if i < len(up):
            c.append(np.bincount(up[i], t[i], len(levels[i + 1].keys)).astype(np.int64))
    for sweep in range(BURN_IN + samples):
        parents = [None] * len(levels)
        p = base
        for i in range(len(levels) - 1, -1, -1):
            parents[i] = p if i == len(levels) - 1 else p[up[i]]
            p = levels[i].predict(c[i], t[i], discounts[i], parents[i])
        for i in range(len(levels)):
            others = levels[i].totals(t[i])[levels[i].of] - t[i]
            t[i] = seat(c[i], parents[i], others, discounts[i], rng)
            if i < len(up):
                c[i + 1] = np.bincount(up[i], t[i], len(levels[i + 1].keys)).astype(np.int64)
        if sweep >= BURN_IN:
            yield [x.copy() for x in c], [x.copy() for x in t]


def low_rows(level: Level, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers that restaurants of two bytes send to those of one byte."""
    own, place = np.unique(level.keys & mask(2), return_inverse=True)
    return own.astype(np.int64), np.bincount(place, t, len(own)).astype(np.int64)


def _first_pass(counts: DataFrame) -> dict[int, int]:
    """Customers of the one-byte restaurants with a table per kind, and counts of counts (keys from 65,536)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                levels, up = chain(expand_sorted(k.as_py()), 2)
                c = expand(c.as_py(), "<i8")
                key, value = low_rows(levels[-1], np.ones(len(levels[-1].keys)))
                key, value = key.tolist(), value.tolist()
                for i, level in enumerate(levels):
                    for j, n in enumerate(discount(c)):
                        key.append(65536 + 2 * i + j)
                        value.append(n)
                    if i < len(up):
                        c = np.bincount(up[i], minlength=len(levels[i + 1].keys))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(value, pa.int64())], ["key", "n"])

    found = counts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {int(r.key): int(r.n) for r in found.collect()}  # at most 65,536 + 8 rows


def sample_low(customers: dict[int, int], seed: int, samples: int) -> list[np.ndarray]:
    """Seatings of the restaurants of one byte and of none: tables of P(byte | byte before)."""
    rng = np.random.default_rng(seed)
    keys = np.array(sorted(k for k in customers if k < 65536), np.uint64)
    if not len(keys):
        return [np.full((256, 256), 1 / 256)] * samples
    c1 = np.array([customers[int(k)] for k in keys], np.int64)
    level, (own, up) = Level(keys), np.unique(keys & mask(1), return_inverse=True)
    zero = Level(own)
    out = []
    for c, t in gibbs([level, zero], [up], c1, np.full(len(own), 1 / 256), (0.5, 0.5), rng, samples):
        p0 = np.full(256, (STRENGTH + 0.5 * t[1].sum()) / (STRENGTH + c[1].sum()) / 256)
        p0[own.astype(int)] += (c[1] - 0.5 * t[1]) / (STRENGTH + c[1].sum())
        p1 = np.tile(p0, (256, 1))
        total, tables = level.totals(c[0]), level.totals(t[0])
        where = level.contexts.astype(int)
        p1[where] *= ((STRENGTH + 0.5 * tables) / (STRENGTH + total))[:, None]
        p1[(keys >> np.uint64(8)).astype(int), (keys & mask(1)).astype(int)] += (c[0] - 0.5 * t[0]) / (STRENGTH + total[level.of])
        out.append(p1)
    return out


def base_of(level: Level, p1: np.ndarray) -> np.ndarray:
    return p1[((level.keys >> np.uint64(8)) & mask(1)).astype(int), (level.keys & mask(1)).astype(int)]


def _second_pass(counts: DataFrame, low, discounts, seed: int) -> dict[int, int]:
    """Customers of the one-byte restaurants after Gibbs sweeps in every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, c in zip(batch.column(2).to_pylist(), batch.column(0), batch.column(1)):
                levels, up = chain(expand_sorted(k.as_py()), 2)
                rng = np.random.default_rng((seed, b))
                for _, t in gibbs(levels, up, expand(c.as_py(), "<i8"), base_of(levels[-1], low[0]), discounts, rng, 1):
                    key, value = low_rows(levels[-1], t[-1])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(value)], ["key", "n"])

    found = counts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {int(r.key): int(r.n) for r in found.collect()}


def _models(counts: DataFrame, low, discounts, seed: int) -> DataFrame:
    """Sampled restaurants of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, c in zip(batch.column(2).to_pylist(), batch.column(0), batch.column(1)):
                levels, up = chain(expand_sorted(k.as_py()), 2)
                rng, sampled = np.random.default_rng((seed, b)), []
                # Every seating of the short contexts goes with one of the long ones.
                for p1 in low:
                    for cs, ts in gibbs(levels, up, expand(c.as_py(), "<i8"), base_of(levels[-1], p1), discounts, rng, 1):
                        own = []
                        for level, d, c_, t_ in zip(levels, discounts, cs, ts):
                            total, tables = level.totals(c_), level.totals(t_)
                            seen = ((c_ - d * t_) / (STRENGTH + total[level.of])).astype(np.float32)
                            own.append((seen, ((STRENGTH + d * tables) / (STRENGTH + total)).astype(np.float32)))
                        sampled.append(own)
                model = pickle.dumps(([(x.keys, x.contexts) for x in levels], sampled))
                model = zstandard.ZstdCompressor(level=1).compress(model)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([model], pa.binary())], ["bucket", "model"])

    return counts.mapInArrow(run, "bucket int, model binary")


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), int), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Index:
    """Finds keys that are all in a sorted table: by one hashed slot, the few that share a slot by search."""

    BITS = 22

    def __init__(self, table: np.ndarray):
        self.table = table
        self.slots = np.zeros(1 << self.BITS, np.int32)
        self.slots[self._slot(table)] = np.arange(len(table), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.table[at] != keys)
        at[other] = np.searchsorted(self.table, keys[other])
        return at


def predict(model, low, keys: np.ndarray) -> np.ndarray:
    """Probability of the last byte of each key, averaged over the seatings."""
    tables, sampled = model if model else ([], [[]] * len(low))
    places = []
    for i, (own, contexts) in enumerate(tables):
        short = keys & mask(DEPTH + 1 - i)
        places.append((find(own, short), find(contexts, short >> np.uint64(8))))
    out = np.zeros(len(keys))
    before, last = ((keys >> np.uint64(8)) & mask(1)).astype(int), (keys & mask(1)).astype(int)
    for p1, levels in zip(low, sampled):
        p = p1[before, last]
        for (seen, share), ((at, hit), (context, known)) in zip(levels[::-1], places[::-1]):
            p = np.where(known, np.where(hit, seen[at], 0) + share[context] * p, p)
        out += p
    return out / len(low)


def _answers(parts: DataFrame, models: DataFrame, words: DataFrame, low, shares: DataFrame, tasks: int) -> DataFrame:
    """What the buckets answer to the blocks: probabilities of sequences and counts of words."""

    def ngram(left: pa.Table, right: pa.Table) -> pa.Table:
        model = None
        if right.num_rows:
            model = pickle.loads(zstandard.ZstdDecompressor().decompress(right.column("model")[0].as_py()))
        values = []
        for k in left.column("keys"):
            values.append(squeeze(np.log10(predict(model, low, expand_sorted(k.as_py()))).astype("<f4")))
        return _answer_table(left, values)

    def word(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = counts = np.empty(0, np.uint64)
        if right.num_rows:
            keys, counts = expand_sorted(right.column("keys")[0].as_py()), expand(right.column("counts")[0].as_py(), "<i8")
        values = []
        for k in left.column("keys"):
            at, hit = find(keys, expand_sorted(k.as_py()))
            values.append(squeeze(np.where(hit, counts[at] if len(counts) else 0, 0).astype("<i8")))
        return _answer_table(left, values)

    schema = "kind int, block long, keys binary, answers binary"
    asked = parts.select("kind", "bucket", "block", "keys")

    def dealt(kind: int, answering: DataFrame):
        """Questions and what answers them, by bucket and share."""
        of_kind = F.broadcast(shares.where(f"kind = {kind}").drop("kind"))  # a row per bucket
        questions = asked.where(f"kind = {kind}").join(of_kind, "bucket").withColumn("share", _share()).drop("shares")
        copies = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
        answering = answering.join(of_kind, "bucket").select(*answering.columns, copies)
        # A stated number of partitions: the work is in the keys' lookup, not in their bytes.
        return [df.repartition(tasks, "bucket", "share").groupBy("bucket", "share") for df in (questions, answering)]

    left, right = dealt(NGRAMS, models)
    a = left.cogroup(right).applyInArrow(ngram, schema)
    left, right = dealt(WORDS, words.select("bucket", "keys", "counts"))
    return a.unionByName(left.cogroup(right).applyInArrow(word, schema))


def _answer_table(left: pa.Table, values: list[bytes]) -> pa.Table:
    return pa.table({"kind": left.column("kind"), "block": left.column("block"), "keys": left.column("keys"), "answers": pa.array(values, pa.binary())})


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scores(parts: DataFrame, answers: DataFrame, n: int, v: int, docs_taught: int) -> DataFrame:
    """A row per document from its block's text and answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = left.column("keys")[0].as_py()
        ids = pickle.loads(raw) if raw[:1] == b"\x80" else expand(raw, "<i8").tolist()
        texts = zstandard.ZstdDecompressor().decompress(left.column("counts")[0].as_py()).split(b"\n")[:-1]
        sequences, logs, words, counts = [], [], [], []
        for kind, k, a in zip(right.column("kind").to_pylist(), right.column("keys"), right.column("answers")):
            k, a = expand_sorted(k.as_py()), a.as_py()
            if kind == NGRAMS:
                sequences.append(k)
                logs.append(expand(a, "<f4"))
            else:
                words.append(k)
                counts.append(expand(a, "<i8"))

        def in_order(keys, values):
            if not keys:
                return np.empty(0, np.uint64), np.empty(0)
            k, x = np.concatenate(keys), np.concatenate(values)
            order = np.argsort(k)
            return k[order], x[order]

        sequences, logs = in_order(sequences, logs)
        place = Index(sequences)
        words, counts = in_order(words, counts)
        under = math.log10(n + 0.1 * (v + 1))
        end = math.log10(docs_taught + 0.1) - under
        rows, at = [], 0
        value: dict[bytes, float] = {}
        unknown: set[bytes] = set()
        while at < len(texts):
            some, size = at, 0
            while at < len(texts) and size <= PART_BYTES:
                size += len(texts[at]) + 1
                at += 1
            chunk = [t + b"\n" for t in texts[some:at]]
            found = logs[place(ngrams(chunk))].astype(np.float64)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in chunk])[:-1]])
            score = np.add.reduceat(found, starts)
            for i, text in enumerate(chunk):
                own = text.split()
                fresh = list({w for w in own if w not in value})
                if fresh:
                    c = counts[find(words, hash_words(fresh))[0]]
                    value.update(zip(fresh, (np.log10(c + 0.1) - under).tolist()))
                    unknown.update(w for w, x in zip(fresh, c) if not x)
                base = math.fsum(map(value.__getitem__, own)) + end
                known = len(own) - (sum(map(unknown.__contains__, own)) if unknown else 0) + (docs_taught > 0)
                doc_id = ids[some + i]
                rows.append((doc_id, is_held(doc_id), len(own) + 1, known, n, base, float(score[i])))
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCORES.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    blocks = parts.where(f"kind = {TEXTS}").select("block", "keys", "counts")
    n_blocks = max(1, blocks.count())
    sides = [df.repartition(n_blocks, "block").groupBy("block") for df in (blocks, answers)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, SCORES)


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int | None = None, seed: int = 5) -> DataFrame:
    """Score every document with a model of those not held out (see `is_held`).

    Columns: key, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens,
    base_score (smoothed word frequencies), score (log10 probability by the model).
    A NULL or empty text is the end alone. Repeated rows are learned from and scored each time. Without
    training documents every byte has probability 1/256. An empty table gives an empty result; other
    columns are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = scratch.store(_blocks(docs.select(F.col(key).cast("long"), F.col(text)), buckets), "blocks")
    asked = parts.where(f"kind <> {TEXTS}")
    shares, total = _shares(asked)
    counts = scratch.store(_merged(asked, shares, total), "counts")
    words = counts.where(f"kind = {WORDS}")
    sequences = counts.where(f"kind = {NGRAMS}").select("keys", "counts", "bucket").repartition(buckets, "bucket")
    tokens, kinds = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    taught = docs.where(~F.coalesce(F.crc32(F.col(key).cast("string")) % HELD_OUT == 0, F.lit(False))).count()

    figures = _first_pass(sequences)
    ones = [(figures.get(65536 + 2 * i, 0), figures.get(65537 + 2 * i, 0)) for i in range(DEPTH - 1)]
    discounts = [min(max(a / (a + 2 * b), 0.1), 0.95) if a + b else 0.5 for a, b in ones]
    low = sample_low(figures, seed, 1)
    low = sample_low(_second_pass(sequences, low, discounts, seed), seed + 1, SAMPLES)
    models = scratch.store(_models(sequences, low, discounts, seed + 2), "models")
    answers = _answers(parts, models, words, low, shares, max(buckets, total))
    n, v = tokens + taught, kinds + (taught > 0)
    return _scores(parts, answers, n, v, taught).withColumnRenamed("doc_id", key)


def query(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = None
