"""Line dedup over levelled, sorted runs of line hashes.

Documents come in batches of descending ids. A batch's line keys are counted (documents that hold
the key, largest id among them) and meet the runs in a merge anti-join: a key that no run holds is
fresh, so the largest id of this batch is the largest of all, and becomes its keeper. The batch
then adds its keys as a run of level 0, sorted and bucketed by the key; `FANOUT` runs of a level are
merged into one of the next, so there are few runs however many batches came. Runs and batches
have the same buckets: the anti-join reads them in place, without a shuffle.

When all batches are in, the keys found in enough documents are known with their keepers. A second pass
over the texts finds the lines to drop, by a join on the key.

Keys go by 128-bit hashes. A document is a row. Defined results:
* a NULL or empty text is one empty line; lines of fewer than `min_chars` code points always stay;
* a line that stands several times in a document counts as one document, and all its places stay or go;
* rows that share an id are documents of their own for the count; if theirs is the largest id, all of them keep the line;
* a row without id counts as a document and loses the line to any row with an id; a line that only rows without id hold stays;
* repeated rows have equal results; an empty table gives an empty result;
* all columns come back; `into`, the column of the figures, must not be among them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from areastats.llm.common import SEPARATORS
from areastats.sources.tables import drop_path, scratch_path

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches in which a whole table is taken.
BATCHES = 6
#: Runs of one level that are merged into one run of the next.
FANOUT = 3
KEY = ["a", "b"]
OCCURRENCE = "doc long, t1 long, t2 long, a long, b long, at array<int>"


def places(text: str | None, min_chars: int) -> dict[bytes, list[int]]:
    """Places of the lines of every key, by the key's hash."""
    import xxhash

    found: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").split("\n")):
        bare = line.strip(SEPARATORS)
        if len(bare) >= min_chars:  # bytes.lower changes A-Z only
            found.setdefault(xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower()), []).append(i)
    return found


def occurrences(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """A row for each document and key: the document's id and text hashes, the key's hash, its places."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, at = [], [], []
            for i, body in enumerate(batch.column(3)):
                found = places(body.as_py(), min_chars)
                rows += [i] * len(found)
                hashes += found
                at += found.values()
            row = pa.array(rows, pa.int64())
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [batch.column(c).take(row) for c in range(3)]
            columns += [pa.array(np.ascontiguousarray(halves[:, c])) for c in range(2)] + [pa.array(at, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "t1", "t2", "a", "b", "at"])

    return docs.select(F.col(key).cast("long").alias("doc"), *identity(text), F.col(text)).mapInArrow(find, OCCURRENCE)


def identity(text: str):
    """Two hashes that, with the id, tell rows of different texts apart."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("line"), text).alias("t2")


class Runs:
    """Sorted runs of line keys in levels: (a, b, n, keeper).

    n: documents of one batch, or of merged batches, that hold the key; keeper: the largest id that
    holds it, in the run of the batch that brought the key first, else NULL.
    """

    def __init__(self, spark, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame, parts: tuple[str, ...] = ()) -> str:
        name = f"llm_lines_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        writer = df.write.format("parquet").option("path", self.paths[name])
        writer = writer.partitionBy(*parts) if parts else writer
        writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def counted(self, found: DataFrame, cuts: list[int]) -> str:
        """Count the keys of all batches in one pass: a table with a part for each batch.

        `cuts` are descending ids: batch 0 holds the ids above the first; rows without id are in the last batch.
        """
        batch = F.lit(len(cuts))
        for i, cut in reversed(list(enumerate(cuts))):
            batch = F.when(F.col("doc") > cut, i).otherwise(batch)
        counts = found.groupBy(*KEY, batch.alias("batch")).agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        return self._write(counts.repartition(self.buckets, *KEY), ("batch",))

    def add(self, batch: DataFrame) -> None:
        """Merge-anti-join a batch of counted keys (a, b, n, last) with the runs and add it as a run.

        One merge does it: the keys without a match in any run are those an anti-join gives, and get a keeper.
        """
        fresh = F.lit(True)
        for i, name in enumerate(self.runs()):
            batch = batch.join(self.spark.table(name).select(*KEY, F.lit(True).alias(f"in{i}")), KEY, "left")
            fresh = fresh & F.col(f"in{i}").isNull()
        run = batch.select(*KEY, "n", F.when(fresh, F.col("last")).alias("keeper"))
        self._push(0, self._write(run))

    def _push(self, level: int, name: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels[level] = []
            merged = self._write(self._merged(old))
            for run in old:
                self._drop(run)
            self._push(level + 1, merged)

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: this Spark takes a union of bucketed tables for one that is dealt out by the key.
        rows = self.spark.read.schema("a long, b long, n long, keeper long").parquet(*[self.paths[name] for name in names])
        return rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys of at least `min_docs` documents with their keepers."""
        return self._merged(self.runs()).where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def build_runs(docs: DataFrame, text: str, key: str, min_chars: int, batches: int) -> Runs:
    """Runs over a whole table, taken in batches of descending ids of about equal numbers of rows."""
    runs = Runs(docs.sparkSession)
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    cuts = docs.select(F.percentile_approx(F.col(key).cast("long"), shares).alias("c")).first().c or []
    cuts = sorted(set(cuts), reverse=True)
    counted = runs.counted(occurrences(docs, text, key, min_chars), cuts)
    for i in range(len(cuts) + 1):
        runs.add(runs.spark.table(counted).where(F.col("batch") == i).drop("batch"))
    runs._drop(counted)
    return runs


@F.arrow_udf(StringType())
def without(text: pa.Array, drops: pa.Array) -> pa.Array:
    """A text without the lines at the given places."""
    out = []
    for body, places_ in zip(text, drops):
        if body.as_py() is None:
            out.append(None)
            continue
        gone = set(places_.as_py())
        out.append("\n".join(line for i, line in enumerate(body.as_py().split("\n")) if i not in gone))
    return pa.array(out, pa.string())


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    into: str = "lines",
) -> DataFrame:
    """All rows and columns, the text without its repeated lines, and struct `into` (n_lines, n_dropped)."""
    if into in docs.columns:
        raise ValueError(f"the documents already have a column {into!r}")
    runs = build_runs(docs, text, key, min_chars, batches)
    # The frequent keys are written, so that the runs can go before the result is read.
    path = scratch_path(docs.sparkSession, "llm-frequent-lines")
    runs.frequent(min_docs).write.parquet(path)
    runs.close()
    frequent = docs.sparkSession.read.schema("a long, b long, n long, keeper long").parquet(path)

    found = occurrences(docs, text, key, min_chars).join(frequent.drop("n"), KEY)
    gone = found.where(~F.col("doc").eqNullSafe(F.col("keeper")))
    # Repeated rows bring the same places; one of them is enough.
    gone = gone.groupBy("doc", "t1", "t2").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("drops"))

    # The given row travels as one struct, so that none of its columns can clash with those added here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("doc"), *identity(text))
    same = rows["doc"].eqNullSafe(gone["doc"]) & (rows["t1"] == gone["t1"]) & (rows["t2"] == gone["t2"])
    body = F.col("row").getField(text)
    joined = rows.join(gone, same, "left").select("row", "drops", without(F.when(F.col("drops").isNotNull(), body), "drops").alias("rest"))
    figures = F.struct(
        F.size(F.split(F.coalesce(body, F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    kept = F.when(F.col("drops").isNull(), body).otherwise(F.col("rest"))
    return joined.select(
        *[kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns], figures.alias(into)
    )


def query(spark, sf_dir):
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "lines.n_lines", "lines.n_dropped", digest.alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM d),
l AS (SELECT r, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key
        HAVING count(DISTINCT r) >= {MIN_DOCS} AND max(doc_id) IS NOT NULL),
g AS (SELECT k.r, k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.keeper AS gone
        FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY r, doc_id"""
