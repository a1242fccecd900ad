"""Mix sources to target weights: a random order inside each source, cut at the source's exact budget of words.

Every document gets a hash key. Rows are range-partitioned by (source, key), so a source with a third of the rows is
simply many ranges; the totals of the ranges are carried forward and give each document its exact place on the word line
of its source. A budget beyond the end of the line starts another epoch of the same line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import n_words
from voicelake.operators.prefix import null_safe, running
from voicelake.session import cut


def random_key(seed: str, key: Column) -> Column:
    """60 bits of md5(seed:key): the same on every run and for any partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, epochs: float) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the weighted shares of `share` times all words.

    Sources in code point order (null last) take the weights in turn. No target exceeds `epochs` times its source; what
    is above is shared again by weight. Those rounds end at one level L with target = min(epochs * size, L * weight), and
    in order of size / weight the capped sources come first, so two running totals find L without rounds.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered = running(sizes, [], order, __place=F.lit(1).cast("bigint"))
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    weighed = numbered.select("source", "source_size", cycle[((F.col("__place") - 1) % len(weights)).cast("int")].alias("__weight"))
    weighed = weighed.withColumn("__ratio", F.col("source_size") / F.col("__weight"))
    upto = running(weighed, [], [F.col("__ratio"), *order], __size_upto=F.col("source_size"), __weight_upto=F.col("__weight"))
    # grand totals: two numbers, then two more
    words, weight = upto.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    budget, most = share * words, F.lit(float(epochs)) * F.col("source_size")
    level_here = (F.lit(budget) - F.lit(float(epochs)) * (F.col("__size_upto") - F.col("source_size"))) / (F.lit(weight) - F.col("__weight_upto") + F.col("__weight"))
    marked = upto.withColumn("__capped", most <= level_here * F.col("__weight"))
    full = marked.where("__capped").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("__weight"), F.lit(0))).first()
    level = (budget - epochs * full[0]) / (weight - full[1]) if weight > full[1] else 0.0
    return marked.select("source", "source_size", F.when(F.col("__capped"), most).otherwise(F.lit(level) * F.col("__weight")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: float = 2.0,
    seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of `docs`; texts are not carried.

    `taken` is how many words of the document the mix uses, repeats counted: whole epochs, plus the part of the document
    that lies before the cut of the last one. The words taken from a source add up to floor(target) exactly.

    A null source is a source of its own, last in order; a null text has size 0 and nothing is taken; rows with one id
    share a hash key and are then ordered by size and the `carry` columns, and equal rows are interchangeable; a null id is the empty id; an
    empty table gives an empty result. Other columns than those in `carry` are not read.
    """
    sized = docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), *[F.col(c) for c in carry])
    keyed = sized.withColumn("__key", random_key(seed, F.col("doc_id")))
    line = running(keyed, ["source"], [F.col("__key"), F.col("doc_id"), F.col("size"), *[F.col(c) for c in carry]], __upto=F.col("size"))
    line = cut(line)
    goals = targets(line.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    joined = null_safe(line, goals, ["source"])
    budget, before = F.floor("target"), F.col("__upto") - F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    left = budget - whole * F.col("source_size") - before
    part = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint")
    return joined.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + part).alias("taken"), *carry)
