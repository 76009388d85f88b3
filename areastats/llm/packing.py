"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous supersteps.

Lengths are whole numbers up to the capacity, so a range of the sorted documents is a class
of one length, and a range of the sorted gaps a class of one gap. A superstep places a
whole class of equal documents: longest first, each class sweeps to its successor gap (the
smallest that holds it), as many documents as the gap's sequences hold are given
out by rank within the class, gaps are updated, and the sweep goes on with what is left; where no gap
is left, sequences are opened. This is best-fit-decreasing, a class at a time.

The sweep only needs how many documents a class has (at most `capacity` counts) and gives runs
of ranks, a number bounded by the capacity and not by the documents. Ranks are found by Spark
without one task per class, and each document finds its run by a join on its length.

Defined results: a NULL or empty text is one piece holding the end token; every row is packed,
repeated rows too; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areastats.llm.common import Scratch

CAPACITY = 1024
END = 2
#: Slices of a length class within which ranks are found one by one.
SLICES = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    """Folder of the public tokenizer files: $TOKENIZERS_DIR, else the installed package's."""
    if os.environ.get("TOKENIZERS_DIR"):
        return os.environ["TOKENIZERS_DIR"]
    import public_tokenizers

    return os.path.dirname(public_tokenizers.__file__)


@functools.lru_cache(maxsize=4)
def encoder(folder: str | None):
    """Byte-level BPE with the ids of byte_bpe_50k.json, read from the same vocabulary's ranks.

    The JSON's added tokens are cut out of a text wherever they stand, as its tokenizer does
    with and without `add_special_tokens`; see `encode_all`.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    folder = folder or default_vocabulary()
    with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(os.path.join(folder, "byte_bpe_50k.json"), encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that depend on what stands beside them are not supported")
    special = {t["content"]: t["id"] for t in added}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_all(enc, text: str) -> list[int]:
    """Ids of a text, its added tokens among them."""
    if any(t in text for t in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first takes what is over."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, text: str, key: str, capacity: int, folder: str | None) -> DataFrame:
    """One row per piece: place in its document, length, CRC-32 of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array(encode_all(enc, body.as_py() or "") + [END], dtype="<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, value in zip(rows, (doc, i, start, length, crc)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(pieces, PIECES)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Place whole classes. Returns runs (length, first rank, end rank, per sequence, first sequence, offset).

    Ranks first .. end - 1 of the class fill consecutive sequences from the first one, `per
    sequence` to each, starting at `offset` there.
    """
    gaps: dict[int, list[list[int]]] = {}  # gap -> stretches [first sequence, end sequence]
    ordered: list[int] = []  # gaps that have sequences, ascending
    runs, opened = [], 0

    def put(gap: int, first: int, end: int) -> None:
        if gap and end > first:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(ordered, gap)
            gaps[gap].append([first, end])

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(ordered, length)
            if at < len(ordered):
                gap = ordered[at]
                first, end = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], ordered[at]
            else:
                gap, first = capacity, opened
                end = opened = first + -(-left // (capacity // length))
            per = gap // length
            full = min(end - first, left // per)  # sequences that get as many as they hold
            over = left - full * per if full < end - first else 0
            over = min(over, per)  # documents of one sequence more
            used = full + (over > 0)
            runs.append((length, rank, rank + full * per + over, per, first, capacity - gap))
            put(gap - per * length, first, first + full)
            if over:
                put(gap - over * length, first + full, first + used)
            put(gap, first + used, end)
            rank += full * per + over
            left -= full * per + over
    return runs


def pack(
    docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None
) -> DataFrame:
    """Pieces of all documents with `sequence_id` and `offset`, gapless from 0 in each sequence."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.store(tokenise(docs, text, key, capacity, vocabulary), "pieces")

    # Ranks within a class: counts per slice give each slice its first rank. A row of
    # `slices` stands for a slice, not a document.
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SLICES)).cast("int"))
    running = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = sliced.withColumn("row", inside).join(slices, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1)

    # At most `capacity` counts come here, and the runs' number is bounded by it too.
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = spark.createDataFrame(
        sweep(counts, capacity), "length long, first long, end long, per long, sequence long, fill long"
    )
    fits = (ranked["length"] == runs["length"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    nth = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(runs), fits).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div per")).alias("sequence_id"),
        (F.col("fill") + (nth % F.col("per")) * ranked["length"]).alias("offset"),
    )


def query(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = None
