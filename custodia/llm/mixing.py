"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies: its source's target words
divided by its source's words. Along a fixed order inside the source these
expectations are summed up, one pseudo-random offset is added, and a
document is emitted once for each integer that its step of the sum crosses.

The order inside a source is (size class, hash bucket, size, doc_id). Sizes
rise along it, so the words taken from a source stay within a few documents
of its target. The prefix sum has two levels: row numbers inside (source,
size class, hash bucket), which splits a source that holds most rows, and
a running count over these groups, of which a source has a bounded number.

Defined cases: a NULL text has size 0; documents of size 0 take part with
0 words; a NULL source is one source, the last; repeated rows are separate
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia.llm.tables import kept

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Hash buckets of a size class; with about 16 classes per octave of size
#: they bound both the largest group and the number of groups of a source.
BUCKETS = 64


def _null_key(name: str):
    return F.col(name).isNull().alias("is_null"), F.coalesce(F.col(name), F.lit("")).alias("key")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, size) rows.

    Targets share the total by weight; none exceeds ``max_repeats`` times
    its source, what is over goes to the others by weight. Sources sorted
    by size per weight reach their cap in that order, so one running sum
    over the sources finds the last one that does.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = src.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(weight, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(int(max_repeats)).cast("long"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    steps = (ranked
             .withColumn("left_words", F.sum("source_size").over(everything)
                         - F.sum("cap").over(by_ratio) + F.col("cap"))
             .withColumn("left_weight", F.sum("weight").over(everything)
                         - F.sum("weight").over(by_ratio) + F.col("weight"))
             .withColumn("step", F.row_number().over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))))
    open_ = F.col("left_words") * F.col("weight") <= F.col("cap") * F.col("left_weight")
    share = F.struct("step", "left_words", "left_weight")
    steps = steps.withColumn("first_open", F.min(F.when(open_, share)).over(everything))
    rate = F.col("first_open.left_words").cast("double") / F.col("first_open.left_weight").cast("double")
    target = F.when(F.col("step") >= F.col("first_open.step"), F.col("weight").cast("double") * rate) \
        .otherwise(F.col("cap").cast("double"))
    return steps.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
                seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its
    source's), copies (how often the mix emits it) and taken words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = kept(docs.select("doc_id", "source", size.alias("size")))

    digits = F.length(F.bin("size"))
    spread = F.pmod(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 20)) * F.lit(2654435761),
                    F.lit(1 << 32))
    rows = (sized
            .withColumn("size_class", digits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))"))
            .withColumn("bucket", F.floor(spread * buckets / (1 << 32)).cast("int")))

    group = ["source", "size_class", "bucket"]
    offset_key = F.concat(F.lit(seed), F.when(F.col("source").isNull(), F.lit(":null"))
                          .otherwise(F.concat(F.lit(":="), F.col("source"))))
    offset = F.conv(F.substring(F.md5(offset_key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    targets = source_targets(sized, weights, max_repeats).select(
        *_null_key("source"), "source_size", "target", offset.alias("shift"))
    before = Window.partitionBy("source").orderBy("size_class", "bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    groups = (rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(before) - F.col("n")))
    groups = (groups.select(*_null_key("source"), "size_class", "bucket", "before")
              .join(targets, ["is_null", "key"]))

    inside = Window.partitionBy(*group).orderBy("size", "doc_id")
    placed = (rows.withColumn("nth", F.row_number().over(inside))
              .select("doc_id", "source", "size", "size_class", "bucket", "nth", *_null_key("source"))
              .join(groups, ["is_null", "key", "size_class", "bucket"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    last = F.col("before") + F.col("nth")
    crossed = (F.floor(rate * last + F.col("shift")) - F.floor(rate * (last - 1) + F.col("shift"))).cast("long")
    return (placed.withColumn("copies", crossed)
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
