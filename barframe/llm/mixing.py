"""Mixing sources to target weights by capped water-filling.

Every source has a size (sum of its documents' sizes) and a weight. The total is shared by weight;
a source's target stops at ``epochs`` times its size and the excess goes to the others by weight,
until no target is above its cap. A source then takes each document a whole number of times, and the
rest of its target from one more round over its documents in a seeded order: whole documents until
the target is met, and of the last one its first words, so that a source takes its target to the word.

Defined results: a null text has size 0; the null source is a source of its own, last in order; a
document of size 0 takes 0 words; with no documents the result is empty; documents without an id or
with the same id and size share a place in the seeded order, which changes no total; in ``mix`` each of
them still takes a share of its own. Nothing is random: the seed, the ids and the texts decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barframe.llm.common import free_name
from barframe.session import cut, settle

EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Targets of (source, source_size, weight): min(cap, level * weight), the level that spends the whole total.

    The sources whose cap is small for their weight fill up first. With the sources in that order, the
    level after the first k are full is (total - their caps) / (weights of the rest); the answer is the
    first level that fills no further source. One row a source, so the window over all of them is small.
    """
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "source")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sources.withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("spare", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        # a source is full if the level before it would lift it to its cap or above
        .withColumn("full", F.col("spare") * F.col("weight") >= F.col("cap") * F.col("open"))
    )
    first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "source", "spare", "open"))).over(everything)
    return filled.withColumn("level", first).select(
        "source", "source_size", "weight",
        F.when(F.col("full"), F.col("cap").cast("double"))
        .otherwise((F.col("level.spare") * F.col("weight")).cast("double") / F.col("level.open")).alias("target"))


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights dealt to the sources by code point, null last, over and over."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))


def _place(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, marked: bool = False) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of ``documents``; if ``marked``, also what ``mix`` needs.

    That is the row's place in the seeded order (place, then doc_id, size and mark, the hash of the text), the whole rounds
    of its source, and extra, its words in the last round. Order within a source is the md5 of seed and id. Its first three digits name one of 4,096 buckets:
    sizes are summed by bucket first, so running totals need one row a bucket and, inside a bucket, its
    own documents only; no task ever holds a whole source.
    """
    spark, mark = documents.sparkSession, ["mark"] if marked else []
    sized = cut(documents.select(
        "doc_id", "source", word_count("text").alias("size"),
        _place(seed).alias("place"),
        *[F.xxhash64("text").alias(m) for m in mark],
    ).withColumn("bucket", F.substring("place", 1, 3)), "mix-sizes")
    # Small tables (one row a source, 4,096 rows a source) are written, so that the planner knows their size and broadcasts by it.
    buckets = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = water_fill(source_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), epochs)
    targets = cut(targets.withColumn("goal", F.round("target").cast("long")), "mix-targets").withColumn(
        "rounds", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)).withColumn(
        "rest", F.col("goal") - F.col("rounds") * F.col("source_size"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(below), F.lit(0)))
    levels = cut(starts.join(targets, starts.source.eqNullSafe(targets.source)).select(
        starts.source, starts.bucket, "bucket_start", "source_size", "target", "rounds", "rest"), "mix-levels")
    rows = sized.join(levels, sized.source.eqNullSafe(levels.source) & (sized.bucket == levels.bucket)).drop(levels.source).drop(levels.bucket)
    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", *mark).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before))
    rows = rows.withColumn("extra", extra).withColumn("taken", F.col("rounds") * F.col("size") + F.col("extra"))
    return rows.select("doc_id", "size", "source", "source_size", "target", "taken", *(["place", "mark", "rounds", "extra"] if marked else []))


def edges(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Where each source's last round ends: (source, rounds, edge, alike, whole, part).

    Documents before ``edge`` are taken once more than ``rounds``. Of the ``alike`` ones at the edge ``whole`` are, too,
    and ``part`` words of one.
    """
    rows = cut(plan(documents, weights, epochs, seed, marked=True).select("source", "rounds", "size", "extra", F.struct("place", "doc_id", "size", "mark").alias("at")), "mix-plan")
    last = cut(rows.groupBy("source").agg(F.first("rounds").alias("rounds"), F.max(F.when(F.col("extra") > 0, F.col("at"))).alias("edge")), "mix-last")
    there = last.select(F.col("source").alias("its"), "edge")
    at_edge = rows.where("size > 0").join(there, F.expr("source <=> its and at <=> edge"))
    ends = at_edge.groupBy("its").agg(F.count(F.lit(1)).alias("alike"), F.count_if(F.col("extra") == F.col("size")).alias("whole"), F.sum(F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0)).alias("part"))
    return last.join(ends, F.expr("source <=> its"), "left").select("source", "rounds", "edge", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alike", "whole", "part")])


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``documents``, each as often as the plan takes it; a part is its first words.

    A source's last round ends at one place of its seeded order, so one row a source tells all and texts are not moved.
    Rows that share that place (equal ids and texts) are numbered, so that each has a share of its own; only those are
    gathered, and only if there are several.
    """
    spark = documents.sparkSession
    size, taken, copy, share, number, at = (free_name(documents, n) for n in ("mix_size", "mix_taken", "mix_copy", "mix_share", "mix_number", "mix_at"))
    names = {n: free_name(documents, f"mix_{n}") for n in ("source", "rounds", "edge", "alike", "whole", "part")}
    ends = settle(spark, lambda: edges(documents, weights, epochs, seed), "mix-edges").withColumnsRenamed(names)
    source, rounds, edge, alike, whole, part = (F.col(n) for n in names.values())
    sized = documents.withColumn(size, word_count("text")).where(F.col(size) > 0).withColumn(
        at, F.struct(_place(seed).alias("place"), "doc_id", F.col(size).alias("size"), F.xxhash64("text").alias("mark")))
    met = sized.join(ends, F.col("source").eqNullSafe(source))
    here = F.col(at).eqNullSafe(edge)
    if ends.where(alike > 1).isEmpty():
        met = met.withColumn(number, F.lit(1))
    else:
        order = [F.col(f"`{c}`") for c, kind in documents.dtypes if not any(x in kind for x in ("map<", "variant"))]
        alone = met.where(~here).withColumn(number, F.lit(1))
        met = alone.unionByName(met.where(here).withColumn(number, F.row_number().over(Window.partitionBy("source").orderBy(*order))))
    extra = F.when(F.col(at) < edge, F.col(size)).when(~here, 0).when(F.col(number) <= whole, F.col(size)).when(F.col(number) == whole + 1, part).otherwise(0)
    joined = met.withColumn(taken, rounds * F.col(size) + F.coalesce(extra, F.lit(0))).where(F.col(taken) > 0)
    times = F.expr(f"`{taken}` div `{size}`")
    repeated = joined.withColumn(share, F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)))).withColumn(copy, F.explode(share))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), (F.col(taken) - times * F.col(size)).cast("int"))
    text = F.when(F.col(copy) <= times, F.col("text")).otherwise(F.array_join(words, " "))
    changed = {"text": text}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(F.col(copy) <= times, F.col("n_chars")).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType)
    return repeated.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in documents.columns])
