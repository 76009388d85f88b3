"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget runs down a tree of levels (domain, language, source). Every parent shares
its budget among its children in proportion to their weights; a child whose subtree cannot
hold its share is filled, and the shortage goes to its siblings by weight. Because a
child's limit is what its whole subtree holds, a shortage reaches the siblings of an
ancestor only when the nearer siblings are full.

A leaf with budget b and t tokens is given out in epochs: as many whole epochs as fit, then
a prefix of a last one. Documents stand in an order seeded per epoch; the prefix
ends with the last document that still fits whole.

Defined results: NULL level values are a child of their own; a value without a weight, NULL too, has
its level's default weight; a negative weight, or a default not given, counts as 0, and such a
child receives nothing; a NULL text has no tokens, and documents
without tokens come along with each whole epoch of their leaf and at their place in a prefix.
Repeated rows count like other documents. An empty table gives an empty result. Columns of the input are
kept whatever their names; only those starting with `_mix` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areastats.llm.common import SEPARATORS, Scratch

UNBOUNDED = (Window.unboundedPreceding, Window.currentRow)


def count_words(text: Column) -> Column:
    """Tokens of a text for the budget: its words."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", F.lit(0)).otherwise(F.regexp_count(bare, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def share_out(nodes: DataFrame, parent: Sequence[str], total: Column) -> DataFrame:
    """Divide each parent's budget `total` among its children (`_mix_w`, `_mix_cap`) as `_mix_budget`.

    Closed form of filling by weight under limits: in order of limit over weight, a child is
    filled exactly if all before it, and the rest at its own ratio, stay within the budget.
    One row per node of the tree is looked at, never a document.
    """
    by = Window.partitionBy(*parent).orderBy("_mix_r", *[c for c in nodes.columns if c.startswith("_mix_k")])
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*parent)
    ranked = (
        nodes.withColumn("_mix_total", total)
        .withColumn("_mix_r", F.when(F.col("_mix_w") > 0, F.col("_mix_cap") / F.col("_mix_w")).otherwise(F.lit(float("inf"))))
        .withColumn("_mix_full", F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0)))
        .withColumn("_mix_open", F.sum("_mix_w").over(everyone) - F.coalesce(F.sum("_mix_w").over(before), F.lit(0.0)))
    )
    full = F.when(F.col("_mix_w") > 0, F.col("_mix_full") + F.col("_mix_r") * F.col("_mix_open") <= F.col("_mix_total")).otherwise(False)
    ranked = ranked.withColumn("_mix_is_full", full)
    spent = F.coalesce(F.sum(F.when(F.col("_mix_is_full"), F.col("_mix_cap"))).over(everyone), F.lit(0.0))
    weight = F.sum(F.when(~F.col("_mix_is_full"), F.col("_mix_w")).otherwise(0.0)).over(everyone)
    rest = F.when(weight > 0, (F.col("_mix_total") - spent) * F.col("_mix_w") / weight).otherwise(0.0)
    got = F.when(F.col("_mix_is_full"), F.col("_mix_cap")).otherwise(rest)
    return ranked.withColumn("_mix_budget", got).drop("_mix_total", "_mix_r", "_mix_full", "_mix_open", "_mix_is_full")


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, tuple[str, Mapping[str, float] | float] | tuple[str, Mapping[str, float], float]],
    budget_share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 7,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """Documents with `_mix_tokens`, `_mix_<level>` and `_mix_copies`, how often each is taken (0 if not at all).

    `levels` maps a level's name, outermost first, to its value (an SQL expression) and its weights (a mapping of
    values to weights, or one weight for every value), and, after a mapping, the weight of each value that
    it lacks (0 if not given). The budget is `budget_share` of all tokens.

    No task holds a leaf: tokens are summed per leaf and slice of the hashed order (65,536
    slices), the running sums of these tell in which slice the prefix ends, and only the
    documents of that slice are looked at one by one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = list(levels)
    keys = [f"_mix_k{i}" for i in range(len(names))]
    tagged = docs.withColumns(
        {
            "_mix_tokens": count_words(F.col(text)),
            **{k: F.coalesce(F.expr(levels[n][0]).cast("string"), F.lit("\x00")) for k, n in zip(keys, names)},
        }
    )
    light = scratch.store(tagged.select(*keys, key, "_mix_tokens"), "mix-tokens")

    # 1. The tree: what each leaf holds, what each inner node holds, budgets from the root down.
    leaves = scratch.store(
        light.groupBy(*keys).agg(F.sum("_mix_tokens").alias("_mix_t"), F.count("*").alias("_mix_n")), "mix-leaves"
    )
    whole = leaves.agg(F.coalesce(F.sum("_mix_t"), F.lit(0)).alias("_mix_all"))
    parents = None
    for i, name in enumerate(names):
        weights = levels[name][1]
        if isinstance(weights, Mapping):
            w = F.lit(float(levels[name][2] if len(levels[name]) > 2 else 0.0))
            for value, given in weights.items():
                w = F.when(F.col(keys[i]) == value, F.lit(float(given))).otherwise(w)
        else:
            w = F.lit(float(weights))
        nodes = leaves.groupBy(*keys[: i + 1]).agg((F.sum("_mix_t") * float(max_epochs)).alias("_mix_cap"))
        nodes = nodes.withColumn("_mix_w", F.when(F.col("_mix_cap") > 0, F.greatest(w, F.lit(0.0))).otherwise(0.0))
        if parents is None:
            nodes = nodes.crossJoin(whole)  # one row
            parents = share_out(nodes, [], F.col("_mix_all") * budget_share).drop("_mix_all")
        else:
            above = parents.select(*keys[:i], F.col("_mix_budget").alias("_mix_above"))
            parents = share_out(nodes.join(above, keys[:i]), keys[:i], F.col("_mix_above")).drop("_mix_above")
    # Budgets count whole tokens; the tiny addition keeps a full leaf full against rounding.
    plan = (
        leaves.join(parents.select(*keys, "_mix_budget"), keys)
        .withColumn("_mix_budget", F.floor(F.col("_mix_budget") + 1e-6).cast("long"))
        .withColumn("_mix_epochs", F.when(F.col("_mix_t") > 0, F.expr("_mix_budget div _mix_t")).otherwise(0))
        .withColumn("_mix_left", F.when(F.col("_mix_t") > 0, F.col("_mix_budget") % F.col("_mix_t")).otherwise(0))
        .select(*keys, "_mix_epochs", "_mix_left")
    )
    plan = scratch.store(plan, "mix-plan")

    # 2. Where the last epoch's prefix ends in the order of its seed.
    place = lambda df: df.withColumn("_mix_h", _seeded(seed, key))
    seeded = place(light.join(plan, keys).where("_mix_left > 0")).withColumn("_mix_s", F.substring("_mix_h", 1, 4))
    running = Window.partitionBy(*keys).orderBy("_mix_s").rowsBetween(*UNBOUNDED)
    slices = seeded.groupBy(*keys, "_mix_s").agg(F.sum("_mix_tokens").alias("_mix_t"), F.first("_mix_left").alias("_mix_l"))
    slices = slices.withColumn("_mix_upto", F.sum("_mix_t").over(running))
    # The first slice that overruns the prefix; the slices before it are taken whole.
    cut = (
        slices.where("_mix_upto > _mix_l")
        .groupBy(*keys)
        .agg(F.expr("min(struct(_mix_s, _mix_upto - _mix_t AS before))").alias("_mix_cut"))
        .select(*keys, "_mix_cut._mix_s", F.col("_mix_cut.before").alias("_mix_before"))
    )
    # Peers (rows of one key) stand at one place, so they are taken together or not at all.
    inside = Window.partitionBy(*keys).orderBy("_mix_h").rangeBetween(*UNBOUNDED)
    stop = (
        seeded.join(cut, [*keys, "_mix_s"])
        .withColumn("_mix_upto", F.col("_mix_before") + F.sum("_mix_tokens").over(inside))
        .where("_mix_upto > _mix_left")
        .groupBy(*keys)
        .agg(F.min("_mix_h").alias("_mix_stop"))
    )
    stops = scratch.store(plan.join(stop, keys, "left"), "mix-stops")

    # 3. One pass over the documents. `stops` has a row per leaf and is read from a file of known
    #    size: Spark sends it to the documents while it is small, and shuffles both sides when not.
    out = place(tagged.join(stops, keys))
    extra = F.when((F.col("_mix_left") > 0) & (F.col("_mix_h") < F.col("_mix_stop")), 1).otherwise(0)
    return (
        out.withColumn("_mix_copies", (F.col("_mix_epochs") + extra).cast("long"))
        .withColumnsRenamed({k: f"_mix_{n}" for k, n in zip(keys, names)})
        .drop("_mix_epochs", "_mix_left", "_mix_stop", "_mix_h")
    )


def _seeded(seed: int, key: str) -> Column:
    """Place of a document in the order of its leaf's last epoch: hex digest of seed, epoch and key."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("_mix_epochs").cast("string"), F.col(key).cast("string")))


#: Levels of the registered query: a domain is a source's number modulo 4 (told by its last two digits, so the
#: number may be of any length), or the CRC-32 of a source that ends in none. A NULL source is a domain of its own.
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
DOMAIN_WEIGHTS = {"0": 0.4, "1": 0.3, "2": 0.2, "3": 0.1}
#: Weight of a domain or language that has none above, NULL too: as much as the least that has.
DEFAULT_WEIGHT = 0.1
DOMAIN = "cast(coalesce(try_cast(regexp_extract(source, '([0-9]{1,2})$', 1) as int), crc32(source)) % 4 as string)"
LEVELS = {
    "domain": (DOMAIN, DOMAIN_WEIGHTS, DEFAULT_WEIGHT),
    "language": ("lang", LANGUAGE_WEIGHTS, DEFAULT_WEIGHT),
    "source": ("source", 1.0),
}


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    mixed = mix_sources(docs, LEVELS)
    return mixed.select("doc_id", "source", "lang", F.col("_mix_tokens").alias("tokens"), F.col("_mix_copies").alias("copies"))


def _fill(name: str, nodes: str, parent: str, keys: str, total: str) -> str:
    """SQL of one level: limits and weights in `nodes` (k, cap, w, total) to budgets."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY r, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
{name}_r AS (SELECT *, {total} AS total, CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END AS r FROM {nodes}),
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER ({by} {order}), 0) AS filled,
    sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} {order}), 0) AS open FROM {name}_r
), {name}_f AS (SELECT *, CASE WHEN w > 0 THEN filled + r * open <= total ELSE false END AS is_full FROM {name}_o),
{name} AS (
  SELECT *, CASE WHEN is_full THEN cap
    WHEN sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}) > 0
      THEN (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0)) * w
           / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by})
    ELSE 0 END AS budget FROM {name}_f
)"""


def _case(col: str, weights: Mapping[str, float]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 0 END"


_D, _L = _case("d", DOMAIN_WEIGHTS), _case("l", LANGUAGE_WEIGHTS)
WITH_SQL = f"""
mix_t AS (
  SELECT *, CAST(CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 4 AS VARCHAR) AS d, lang AS l, source AS s,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS tokens
  FROM mix_docs
), leaf AS (SELECT d, l, s, sum(tokens)::BIGINT AS t FROM mix_t GROUP BY ALL),
n1 AS (SELECT d, 2.0::DOUBLE * sum(t)::DOUBLE AS cap, CASE WHEN sum(t) > 0 THEN ({_D})::DOUBLE ELSE 0 END AS w FROM leaf GROUP BY d),
{_fill("b1", "n1", "", "d", "(SELECT sum(t) FROM leaf)::DOUBLE")},
n2 AS (
  SELECT x.*, b1.budget AS above FROM (
    SELECT d, l, 2.0::DOUBLE * sum(t)::DOUBLE AS cap, CASE WHEN sum(t) > 0 THEN ({_L})::DOUBLE ELSE 0 END AS w FROM leaf GROUP BY d, l
  ) x JOIN b1 USING (d)
), {_fill("b2", "n2", "d", "l", "above")},
n3 AS (
  SELECT leaf.d, leaf.l, leaf.s, 2.0::DOUBLE * t::DOUBLE AS cap, CASE WHEN t > 0 THEN 1.0::DOUBLE ELSE 0 END AS w, b2.budget AS above
  FROM leaf JOIN b2 USING (d, l)
), {_fill("b3", "n3", "d, l", "s", "above")},
plan AS (
  SELECT d, l, s, CASE WHEN t > 0 THEN floor(budget + 1e-6)::BIGINT // t ELSE 0 END AS epochs,
    CASE WHEN t > 0 THEN floor(budget + 1e-6)::BIGINT % t ELSE 0 END AS rest FROM leaf JOIN b3 USING (d, l, s)
), placed AS (
  SELECT mix_t.*, epochs, rest, md5(concat('7/', epochs, '/', doc_id)) AS h FROM mix_t JOIN plan USING (d, l, s)
), ran AS (SELECT *, sum(tokens) OVER (PARTITION BY d, l, s ORDER BY h) AS upto FROM placed),
mixed AS (
  SELECT *, CAST(epochs + CASE WHEN rest > 0 AND max(upto) OVER (PARTITION BY d, l, s ORDER BY h) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM ran
)"""
ORACLE = f"WITH mix_docs AS (SELECT * FROM documents), {WITH_SQL} SELECT doc_id, source, lang, tokens, copies FROM mixed"
