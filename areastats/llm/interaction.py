"""How text filters interact, audited by a stream that retracts.

The files of a table arrive as available-now micro-batches. Every document gets a mask of the filters it
fails. Whether a text repeats that of a smaller id is not known when it arrives, so state keyed by the
text keeps its smallest id: the first holder passes; when a smaller id arrives, the holder's earlier
mask is retracted from the counters of its part and put back with the filter for copies set.

State is grouped in slots of text hashes, each a sorted table of the texts' smallest ids, so a task
works on whole arrays. Rows of a text that are not the smallest of their Arrow batch fail for certain and go
to a slot by their own id: a text that a third of the rows share sends one row a batch to its slot.
Each micro-batch adds up its changes by (part, mask, labels) and writes them to a table of its own, which
is overwritten if the batch is tried again. The counters are the sums over these tables: at most 128 rows a part. All
orders of the filters are then worked out from the masks.

Defined results: a NULL text is empty; a NULL part is the empty string; a row without id neither is
a copy nor makes copies; rows with the same text and the same smallest id all pass; a label counts
if any row of `labels` with the id has it; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areastats.llm.common import Scratch
from areastats.sources.tables import drop_path, scratch_path

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Micro-batches in which all files are taken.
BATCHES = 4
#: Documents whose state shares a slot, about.
SLOT = 2048
UPPER = re.compile("[A-Z]+")
MARKS = re.compile(r"[#$%&*|]")
#: No column holds a NULL: pandas would make its numbers floating, and lose the last digits of hashes and ids.
MASKED = "slot int, h1 long, h2 long, id long, part string, mask int, final boolean, named boolean"
CHANGE = "id long, part string, mask int, n long"


def failures(text: str) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.encode("utf-8", "surrogatepass").split()
    upper = sum(map(len, UPPER.findall(text)))
    failed = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * len(text), bool(MARKS.search(text)))
    return sum(1 << i for i, f in enumerate(failed) if f)


def masked(docs: DataFrame, slots: int) -> DataFrame:
    """A row per document: slot, text hash, id, part and mask; whether the mask is final, and the row has an id."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(1).to_pylist()]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), "<i8").reshape(-1, 2)
            ids = batch.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            out = pd.DataFrame({"h1": halves[:, 0], "h2": halves[:, 1], "id": ids.fill_null(0).to_numpy(), "named": named})
            out["part"] = [p or "" for p in batch.column(2).to_pylist()]
            out["mask"] = np.array([failures(t) for t in texts], np.int32)
            copy = pd.Series(False, out.index)
            own = out[named]
            copy[own.index] = own["id"] != own.groupby(["h1", "h2"])["id"].transform("min")
            out["mask"] |= np.where(copy, COPY, 0).astype(np.int32)
            out["final"] = copy | ~named
            # What is final has no business with its text's slot.
            spread = np.where(out["final"], pd.util.hash_array(np.where(named, out["id"], np.arange(len(out)))).astype(np.int64), out["h1"])
            out["slot"] = (spread % slots).astype(np.int32)
            yield pa.RecordBatch.from_pandas(out[ARROW.names], schema=ARROW, preserve_index=False)

    return docs.mapInArrow(measure, MASKED)


ARROW = pa.schema(
    [("slot", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32())]
    + [("final", pa.bool_()), ("named", pa.bool_())]
)
HELD = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])


def settle(held: pd.DataFrame, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Merge arriving rows into a slot's holders. Returns the holders and the changes of the counters."""
    new = new.assign(n=1, old=0)
    both = pd.concat([held.assign(old=held["n"]), new], ignore_index=True)
    both = both.groupby(["h1", "h2", "id", "part", "mask"], as_index=False, sort=True)[["n", "old"]].sum()
    passes = both["id"] == both.groupby(["h1", "h2"])["id"].transform("min")
    # Before, all holders passed. What is new counts under its mask; a holder that fails now moves to the mask with the copy filter.
    plain = both.assign(n=np.where(passes, both["n"] - both["old"], -both["old"]))
    copies = both[~passes].assign(mask=both["mask"] | COPY)
    changes = pd.concat([plain, copies], ignore_index=True)
    return both.loc[passes, HELD.names], changes.loc[changes["n"] != 0, ["id", "part", "mask", "n"]]


def retract(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keyed state of one slot: the holders as an Arrow stream."""
    rows = pd.concat(list(frames), ignore_index=True)
    final = rows[rows["final"]]
    if len(final):
        yield final[["part", "mask"]].assign(id=final["id"].astype("Int64").where(final["named"]), n=1)[["id", "part", "mask", "n"]]
    rows = rows[~rows["final"]]
    if not len(rows):
        return
    held = HELD.empty_table()
    if state.exists:
        held = pa.ipc.open_stream(state.get[0]).read_all()
    kept, changes = settle(held.to_pandas(), rows[["h1", "h2", "id", "part", "mask"]])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as writer:
        writer.write_table(pa.Table.from_pandas(kept, schema=HELD, preserve_index=False))
    state.update((sink.getvalue().to_pybytes(),))
    yield changes


def flags(labels: DataFrame) -> DataFrame:
    """One row per labelled id."""
    some = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(some("quality").alias("good"), some("toxic").alias("toxic"))


def stream_counters(spark: SparkSession, path: str, labels: DataFrame, checkpoint: str, batches: int = BATCHES) -> DataFrame:
    """Counters (part, mask, good, toxic, n) of all files under `path`, by a stream that can be taken up again.

    `checkpoint` is the stream's folder on shared storage: run again with the same one, it goes on with
    the files that have arrived since and corrects the counters.
    """
    docs = spark.read.parquet(path)
    files = len(docs.inputFiles())
    plan = scratch_plan(spark, checkpoint, docs)
    source = f"{path[:-1]}[{path[-1]}]"  # a pattern: a plain path has to be a folder, the table may be a single file
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(source)
    rows = masked(stream.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string")), plan)
    changes = rows.groupBy("slot").applyInPandasWithState(retract, CHANGE, "held binary", "append", "NoTimeout")
    known = flags(labels)

    def count(batch: DataFrame, number: int) -> None:
        seen = batch.join(known, "id", "left")
        no = F.lit(False)
        sums = seen.groupBy("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{checkpoint}/counters/batch={number}")

    query_ = changes.writeStream.foreachBatch(count).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query_.awaitTermination()
    # An empty table has no batch; the empty frame gives the schema.
    counted = spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean, n long")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/counters")
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        counted = spark.read.schema(counted.schema).parquet(f"{checkpoint}/counters")
    return counted.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).where("n <> 0")


def scratch_plan(spark: SparkSession, checkpoint: str, docs: DataFrame) -> int:
    """Number of slots, fixed by the first run of a checkpoint: a text must stay in its slot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/slots")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.parquet(f"{checkpoint}/slots").first().slots
    slots = max(64, -(-docs.count() // SLOT))
    spark.range(1).select(F.lit(slots).alias("slots")).write.parquet(f"{checkpoint}/slots")
    return slots


def orders() -> list[tuple[int, str, int, str, bool, bool, bool, bool]]:
    """For every mask, order and step: whether a document of the mask is kept, removed, redundant, or fails this filter alone."""
    out = []
    for mask in range(1 << len(FILTERS)):
        for order in itertools.permutations(FILTERS):
            gone = False
            for step, name in enumerate(order, 1):
                bit = 1 << FILTERS.index(name)
                fails = bool(mask & bit)
                removed = fails and not gone
                out.append((mask, "".join(order), step, name, not gone and not fails, removed, fails and gone, mask == bit))
                gone = gone or fails
    return out


def interactions(counters: DataFrame) -> DataFrame:
    """One row per part, order and step, worked out from the counters of masks."""
    spark = counters.sparkSession
    schema = "mask int, filter_order string, step int, filter string, is_kept boolean, is_removed boolean, is_redundant boolean, is_unique boolean"
    steps = F.broadcast(spark.createDataFrame(pd.DataFrame(orders(), columns=[c.split()[0] for c in schema.split(", ")]), schema))
    # All masks stand in `steps` with all steps, so every part has all rows, zeros included.
    count = lambda *when: F.sum(F.when(F.expr(" AND ".join(when)), F.col("n")).otherwise(0)).cast("long")
    table = counters.join(steps, "mask").groupBy("part", "filter_order", "step", "filter").agg(
        count("is_kept").alias("kept"),
        count("is_removed").alias("removed"),
        count("is_redundant").alias("redundant"),
        count("is_unique").alias("unique_fails"),
        count("is_removed", "good").alias("good_lost"),
        count("is_removed", "toxic").alias("toxic_lost"),
    )
    total = table.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return table.join(total, ["part", "filter"]).drop("filter")


def audit(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The whole audit of the files under `path`."""
    scratch = Scratch(spark)
    checkpoint = scratch_path(spark, "llm-audit")
    counters = scratch.store(stream_counters(spark, path, labels, checkpoint), "counters")
    drop_path(spark, checkpoint)
    return interactions(counters)


def query(spark, sf_dir):
    return audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _oracle() -> str:
    rows = ", ".join(f"({m}, '{o}', {s}, '{f}', {k}, {r}, {d}, {u})" for m, o, s, f, k, r, d, u in orders())
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS mask FROM w),
b AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN b ON m.doc_id = b.doc_id GROUP BY ALL),
p (mask, filter_order, step, filter, is_kept, is_removed, is_redundant, is_unique) AS (VALUES {rows}),
g AS (SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(n) FILTER (WHERE is_kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE is_removed), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE is_redundant), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE is_unique), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (WHERE is_removed AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (WHERE is_removed AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM c JOIN p ON c.mask = p.mask GROUP BY ALL)
SELECT * EXCLUDE (filter), CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM g"""


ORACLE = _oracle()
