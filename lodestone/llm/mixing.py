"""Mixing sources to target weights by weighted fair queueing. Only DataFrame functions.

Every document gets a place in its source's shuffled order (a hash of the seed and its id). Reading the sources over and
over, at most `max_epochs` times, the item (document, epoch) has the virtual finish time
(cumulative source words up to and with it) / (target of its source); all items are range-sorted by that time and cut
where their words reach the total budget. Every sum is of integers, so reruns agree.

Running sums never need a source or the corpus in one task: a source's order is cut in hash ranges, whose sums (at most
one row per few hundred documents) give the offsets; the global order is cut in ranges of finish time, 8192 and with more
than four million documents one per ROWS_PER_BIN of them (at most a million), and only the range in which the budget runs
out is sorted.

Defined cases: a null text or one without words has size 0 and takes 0; the null source is a source of its own, last in
order; a source of blank texts only has target 0 and takes nothing; null ids sort first; identical rows may share a place in any order; an empty table gives an empty result;
texts of any length are counted whole; the mix's own rows keep all columns, whatever their names.
The source table (one row per distinct source) is ordered in one task: sources are a label set, not a key of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, saved_alone

#: Ranges of finish time, at least and at most; the budget runs out in one of them.
TIME_BINS, MOST_TIME_BINS = 1 << 13, 1 << 20
#: Documents in a hash range of a source, about.
ROWS_PER_BIN = 512


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(seed: str) -> Column:
    """60 bits of an md5 of seed and doc_id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, n_docs, weight, target from (source, size). Weights repeat in the order of the sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    # Water level: sources in the order in which they fill up; the level is that of the first that does not.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    per = per.withColumn("_level", level)
    water = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("_level"), F.struct(F.col("cap") / F.col("weight"), "_level"))).over(everything)["_level"]
    per = per.withColumn("_water", water)
    target = F.when(F.col("_water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("_water") * F.col("weight")))
    return per.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), budget: int | None = None) -> DataFrame:
    """doc_id, source, size, place, source_size, target, copies, taken for every row. Only narrow columns are shuffled."""
    sized = saved(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), _place(seed).alias("place")), "mix-sizes")
    targets = saved(source_targets(sized, max_epochs, weights), "mix-targets")
    total = targets.agg(F.sum("source_size").alias("words"), F.sum("n_docs").alias("docs")).first()
    budget = int(total["words"] or 0) if budget is None else budget
    bins = max(1, -(-int(total["docs"] or 0) // ROWS_PER_BIN))
    time_bins = min(max(TIME_BINS, bins), MOST_TIME_BINS)

    # The null source sorts last: 's...' < 't'.
    keyed = sized.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))).withColumn("_bin", F.floor(F.col("place") / F.lit(float(1 << 60)) * bins).cast("int"))
    sums = keyed.groupBy("_s", "_bin").agg(F.sum("size").alias("_sum"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    known = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("_s"), "source_size", "target")
    offsets = saved(offsets.join(known, "_s").select("_s", "_bin", "_before", "source_size", "target"), "mix-offsets")
    running = Window.partitionBy("_s", "_bin").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_within", F.sum("size").over(running)).join(offsets, ["_s", "_bin"])
    placed = saved(placed.withColumn("_cum", F.col("_before") + F.col("_within")).drop("_bin", "_before", "_within"), "mix-placed")

    epochs = [(e, F.try_divide(F.col("_cum") + F.col("source_size") * (e - 1), "target")) for e in range(1, max_epochs + 1)]
    slot = lambda f: F.floor(f / (1 + f) * time_bins).cast("int")
    order = lambda f: F.struct(f.alias("f"), F.col("_s"), F.col("place"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size").alias("n"))
    items = placed.filter("target > 0").select("_s", "place", "doc_id", "size", F.explode(F.array(*[f for _, f in epochs])).alias("_f"))
    items = items.withColumn("_slot", slot(F.col("_f")))
    per_slot = items.groupBy("_slot").agg(F.sum("size").alias("_sum"))
    filled = per_slot.withColumn("_upto", F.sum("_sum").over(Window.orderBy("_slot")))
    cut = filled.filter(F.col("_upto") > budget).agg(F.min(F.struct("_slot", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("c")).first()["c"]
    if cut is None:
        copies = F.when(F.col("target") > 0, F.lit(max_epochs)).otherwise(F.lit(0))
    else:
        last = items.filter(F.col("_slot") == cut["_slot"]).withColumn("_o", order(F.col("_f")))
        last = last.withColumn("_run", F.sum("size").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
        end = last.filter(F.col("_run") + cut["before"] <= budget).agg(F.max("_o").alias("o")).first()["o"]
        taken = F.lit(0)
        for _, f in epochs:
            fits = slot(f) < cut["_slot"]
            if end is not None:
                edge = F.struct(F.lit(end["f"]).alias("f"), F.lit(end["_s"]).alias("_s"), F.lit(end["place"]).alias("place"), F.lit(end["id"]).alias("id"), F.lit(end["n"]).alias("n"))
                fits = fits | ((slot(f) == cut["_slot"]) & (order(f) <= edge))
            taken = taken + F.when((F.col("target") > 0) & fits, 1).otherwise(0)
        copies = taken
    return placed.withColumn("copies", copies.cast("int")).select(
        "doc_id", "source", "size", "place", F.col("source_size").cast("long"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as the mix takes it.

    In a source, what is taken is a prefix of the shuffled order, so a source's cut is one row and texts are not shuffled.
    """
    key = F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size"))
    # The last place that is taken most often is the place with the most copies, the farthest of them.

    def build() -> DataFrame:
        cuts = mix(docs, seed, max_epochs, weights).groupBy("source").agg(F.max(F.struct("copies", key.alias("key"))).alias("top"), F.min("copies").alias("least"))
        return cuts.select(F.col("source").alias("of"), F.col("top.copies").alias("most"), "least", F.col("top.key").alias("last"))

    cuts = saved_alone(docs.sparkSession, "mix-cuts", build)
    mine = F.struct(_place(seed).alias("place"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), words_in(F.col("text")).alias("size"))
    # The caller's columns travel in a struct, so that none of their names can clash.
    rows = docs.select(F.struct("*").alias("row"), "source", mine.alias("mine"))
    times = F.when(F.col("mine") <= F.col("last"), F.col("most")).otherwise(F.col("least"))
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("times", times).filter("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def mix_sql(table: str, seed: str = "mix-1", max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS BIGINT) AS size,
      CAST('0x' || substr(md5('{seed}' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place FROM {table}),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END AS weight, source_size * {max_epochs} AS cap FROM s),
    l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
    g AS (SELECT min_by(level, cap / weight) FILTER (cap / weight >= level) AS water FROM l),
    t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), water * weight) END AS target FROM l, g),
    c AS (SELECT d.*, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    i AS (SELECT *, (cum + source_size * (e - 1)) / target AS f FROM c, (SELECT unnest(range(1, {max_epochs + 1})) AS e) WHERE target > 0),
    r AS (SELECT *, sum(size) OVER (ORDER BY f, source NULLS LAST, place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS run FROM i),
    k AS (SELECT doc_id, source, size, place, sum(size) AS taken FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
    SELECT c.doc_id, c.size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM c
    LEFT JOIN k ON c.doc_id IS NOT DISTINCT FROM k.doc_id AND c.source IS NOT DISTINCT FROM k.source AND c.size = k.size"""
