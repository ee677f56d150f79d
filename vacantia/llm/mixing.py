"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash. For a budget of words of a source, the documents whose hash is not above a
threshold are taken, so a larger budget takes a superset. Thresholds come from histograms of words by source and hash
bucket: one pass finds the bucket in which a budget ends, the next passes refine that bucket alone, until
one hash is left. Nothing is sorted, and shuffles carry one row per source, bucket and task.

Defined results: a null text has no words; a null source is a source of its own, last in order; equal rows share their
hash and are taken together; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.llm.common import n_words, quoted, written

HASH_BITS = 60
#: Bits that a histogram resolves; a source has up to 2**10 buckets.
STEP_BITS = 10
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def mix_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) to (source, size, target).

    Sources in ascending order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``max_repeats`` times the size; its excess is shared again by weight. The rounds of sharing end where sources in
    ascending order of ``cap / weight`` are full up to some place, so running sums over one row per source give the
    end result.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sizes.select("source", "size").withColumn(
        "weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("size") * max_repeats)
    rows = rows.withColumns({
        "left": F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open_weight": F.sum("weight").over(rest),
    })
    rows = rows.withColumn("full", F.col("cap") * F.col("open_weight") <= F.col("left") * F.col("weight"))
    left, open_weight = (F.max(F.when(~F.col("full"), F.col(c))).over(everything) for c in ("left", "open_weight"))
    share = left.cast("double") * F.col("weight") / open_weight
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select("source", "size", "target")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Hash thresholds of nested budgets.

    ``sized`` has (source, size, h); ``budgets`` has (source, level, budget) in words. The result has (source, level,
    threshold): the documents with ``h <= threshold`` have the number of words nearest to the budget that a
    threshold can give, the smaller one on a tie. Budgets of a source are nested because they share the hashes.
    """
    state = budgets.select(
        "source", "level", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done: DataFrame | None = None
    shift = HASH_BITS
    while True:
        shift -= STEP_BITS
        histogram = (
            _inside(sized, state, shift + STEP_BITS)
            .groupBy("source", "level", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"), F.first("left").alias("left")))
        order = Window.partitionBy("source", "level").orderBy("bucket")
        cumulated = histogram.withColumn("upto", F.sum("words").over(order))
        # The last bucket that fits as a whole, and the first that does not.
        fits = F.col("upto") <= F.col("left")
        found = cumulated.groupBy("source", "level").agg(
            F.first("left").alias("left"),
            F.max(F.when(fits, F.col("high"))).alias("below"),
            F.max(F.when(fits, F.col("upto"))).alias("below_words"),
            F.min(F.when(~fits, F.struct("bucket", "words", "low", "high"))).alias("edge"))
        found = written(found.withColumn("below_words", F.coalesce("below_words", F.lit(0))), "mix-edges")
        # A bucket with one hash is taken if that comes nearer to the budget.
        take_edge = 2 * (F.col("left") - F.col("below_words")) > F.col("edge.words")
        single = F.col("edge").isNull() | (F.col("edge.low") == F.col("edge.high"))
        floor = F.coalesce("below", F.lit(-1))
        ended = found.where(single).select(
            "source", "level", F.when(F.col("edge").isNotNull() & take_edge, F.col("edge.high")).otherwise(floor).alias("threshold"))
        # Where the edge bucket is empty of fitting documents, the answer is the last hash below it.
        open_rows = found.where(~single).select(
            "source", "level", (F.col("left") - F.col("below_words")).alias("left"), F.col("edge.bucket").alias("prefix"),
            floor.alias("floor"))
        kept_floor = open_rows.select("source", "level", F.col("floor").alias("threshold"))
        part = ended.unionByName(kept_floor)
        done = part if done is None else done.unionByName(part)
        if shift == 0 or open_rows.isEmpty():
            # Later steps know a higher or an equal threshold; those that found nothing below give -1.
            return done.groupBy("source", "level").agg(F.max("threshold").alias("threshold"))
        state = open_rows.select("source", "level", "left", "prefix")


def _inside(sized: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Documents inside the open bucket of each budget."""
    s, b = sized.select("source", "size", "h").alias("s"), state.alias("b")
    same = F.col("s.source").eqNullSafe(F.col("b.source")) & (F.shiftright(F.col("s.h"), shift) == F.col("b.prefix"))
    return s.join(b, same).select("s.source", "s.size", "s.h", "b.level", "b.left")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: (source, source_size, target, levels), where a document is taken once for every
    threshold in ``levels`` that its hash does not exceed."""
    goals = written(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, max_repeats), "mix-targets")
    everything, nothing = F.lit((1 << HASH_BITS) - 1), F.lit(-1)
    passes = goals.select("source", "size", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("level"), "target")
    passes = passes.withColumn("budget", F.col("target") - (F.col("level") - 1) * F.col("size"))
    searched = passes.where((F.col("budget") > 0) & (F.col("budget") < F.col("size"))).select("source", "level", "budget")
    whole = passes.where((F.col("budget") <= 0) | (F.col("budget") >= F.col("size"))).select(
        "source", "level", F.when((F.col("budget") <= 0) & (F.col("size") > 0), nothing).when(F.col("level") == 1, everything)
        .when(F.col("size") > 0, everything).otherwise(nothing).alias("threshold"))
    levels = thresholds(sized, searched).unionByName(whole).groupBy("source").agg(
        F.sort_array(F.collect_list("threshold"), asc=False).alias("levels"))
    g, l = goals.alias("g"), levels.alias("l")
    return written(g.join(l, F.col("g.source").eqNullSafe(F.col("l.source"))).select(
        F.col("g.source").alias("source"), F.col("g.size").alias("source_size"), "g.target", "l.levels"), "mix-plan")


def copies(h: Column, levels: Column) -> Column:
    """How often a document is taken."""
    return F.size(F.filter(levels, lambda t: h <= t)).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mix_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words taken, repeats counted), copies."""
    sized = written(sized_documents(docs), "mix-sizes")
    s, p = sized.alias("s"), plan_mix(sized, weights, max_repeats).alias("p")
    joined = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")))
    out = joined.select("s.doc_id", "s.size", "p.source_size", "p.target", copies(F.col("s.h"), F.col("p.levels")).alias("copies"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The documents themselves with all their columns, whatever they are called, repeated or left out as the mix says. The texts are not shuffled while the plan
    of the sources is small enough for Spark to broadcast it."""
    plan = plan_mix(written(sized_documents(docs), "mix-sizes"), weights, max_repeats)
    # The row goes along as one struct, so its columns meet no names of ours.
    d = docs.select(
        F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("doc"), F.col("source").alias("of"), mix_hash(F.col("doc_id"), F.col("text")).alias("h"))
    joined = d.join(plan, F.col("of").eqNullSafe(F.col("source")))
    times = F.array_repeat(F.lit(1), copies(F.col("h"), F.col("levels")).cast("int"))
    return joined.select("doc", F.explode(times).alias("copy")).select("doc.*")


#: The same mix by sorting: for the SQL check.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM {documents}),
named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
running AS (
  SELECT *, sum(size) OVER () - coalesce(sum(3 * size) OVER (ORDER BY 3.0 * size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY 3.0 * size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM named),
filled AS (SELECT *, 3 * size * open_weight <= remaining * weight AS is_full FROM running),
goals AS (
  SELECT source, size, CASE WHEN is_full THEN CAST(3 * size AS DOUBLE)
    ELSE CAST(max(CASE WHEN NOT is_full THEN remaining END) OVER () AS DOUBLE) * weight / max(CASE WHEN NOT is_full THEN open_weight END) OVER () END AS target
  FROM filled),
summed AS (
  SELECT s.*, g.size AS source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (
  SELECT *, target - source_size * k AS budget, k FROM summed, (VALUES (0), (1), (2)) AS t(k)),
taken AS (
  SELECT *, CASE WHEN budget >= source_size THEN source_size > 0 OR k = 0 WHEN budget <= 0 THEN FALSE
    WHEN upto <= budget THEN TRUE ELSE upto - own <= budget AND 2 * (budget - (upto - own)) > own END AS is_taken
  FROM passes)
SELECT doc_id, size, source_size, target, CAST(size * sum(CASE WHEN is_taken THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(sum(CASE WHEN is_taken THEN 1 ELSE 0 END) AS BIGINT) AS copies
FROM taken GROUP BY doc_id, source, h, size, source_size, target
"""
