"""Delete later copies of line runs that repeat across or inside documents.

The lines with a word form one sequence per document. Prefix doubling names the runs of 1, 2, 4, 8 ... lines that start
at each place: all suffixes that begin with the same run are one longest-common-prefix interval, and its name is the
first place in it. A run of any length l is named by the two overlapping power-of-two runs that cover it. A copy is a
run of at least `min_words` words whose interval starts at an earlier place; every line that a copy covers is deleted.

A line inside a long repeated run lies in a copy just over the limit as well: in the shortest one that starts at its
place, or ends there, or in the shortest one at the start of the long run. So the intervals at depth `shortest run from
here` and `shortest run up to here` give exactly the lines of the maximal repeated runs, and the doubling stops at the
longest of those, at most `min_words` lines, instead of the longest copy in the corpus.

Only lines that occur twice or more enter the doubling. Names are grouped minima with partial aggregation, joined back;
no window or list ever holds an interval, so a line that a third of the corpus shares is one aggregated row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicelake.llm.common import indices, whole, words_of
from voicelake.operators.prefix import null_safe, ranked
from voicelake.session import cut

#: Bits of a place that count the lines of one document.
LINE_BITS = 27


def place(d: Column, line: Column) -> Column:
    return F.shiftleft(d, LINE_BITS) + line


def line_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row per distinct (id, text): the document's number `d` in id order and its lines with a word."""
    parts = F.split(whole(F.col(text)), "\n")
    numbered = F.transform(
        parts,
        lambda x, o: F.struct(o.alias("o"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), F.size(words_of(x)).alias("w")),
    )
    short = docs.select(F.col(id).alias("__id"), F.xxhash64(whole(F.col(text))).alias("__hash"), F.filter(numbered, lambda x: x["w"] > 0).alias("__lines"))
    return ranked(short.dropDuplicates(["__id", "__hash"]), [], [F.col("__id").asc_nulls_first(), F.col("__hash")], "d")


def named(rows: DataFrame, *keys: str) -> DataFrame:
    """(d, l, name) of the rows whose keys occur more than once; the name is the first place that has them."""
    groups = rows.groupBy(*keys).agg(F.min(place(F.col("d"), F.col("l"))).alias("name"), F.count("*").alias("__n")).where("__n > 1")
    # as a table, so that the join is dealt apart from the aggregate and Spark may split a hot key
    return rows.join(cut(groups.drop("__n")), list(keys))


def doubled(level: DataFrame, k: int) -> DataFrame:
    """The names of runs of 2k lines from those of k lines."""
    later = level.select("d", (F.col("l") - k).alias("l"), F.col("name").alias("b"))
    pairs = level.select("d", "l", F.col("name").alias("a")).join(later, ["d", "l"])
    return named(pairs, "a", "b").select("d", "l", "name")


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, s, n): for each repeated line the shortest run of repeated lines with enough words from it, and up to it."""
    order = Window.partitionBy("d").orderBy("l")

    def length(items: Column, step: int) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
        grown = F.aggregate(
            items,
            start,
            lambda a, x: F.when((a["words"] < min_words) & (x["l"] == F.col("l") + step * a["n"]), F.struct((a["n"] + 1).alias("n"), (a["words"] + x["w"]).alias("words"))).otherwise(a),
        )
        return F.when(grown["words"] >= min_words, grown["n"])

    item = F.struct(F.col("l").alias("l"), F.col("w").alias("w"))
    around = lines.select("d", "l", F.collect_list(item).over(order.rowsBetween(0, min_words - 1)).alias("after"), F.collect_list(item).over(order.rowsBetween(1 - min_words, 0)).alias("before"))
    found = around.select("d", "l", length(F.col("after"), 1).alias("n"), length(F.reverse("before"), -1).alias("m"))
    starts = found.select("d", F.explode(F.array(F.struct(F.col("l").alias("s"), F.col("n").alias("n")), F.struct((F.col("l") - F.col("m") + 1).alias("s"), F.col("m").alias("n")))).alias("r"))
    return starts.select("d", "r.s", "r.n").where("n IS NOT NULL").distinct()


def copied_lines(docs: DataFrame, min_words: int = 10, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(__id, __hash, lines, words): the numbers of the lines to delete in each document that has any."""
    source = cut(line_rows(docs, id, text))
    rows = source.select("d", F.posexplode("__lines").alias("l", "x")).select("d", "l", "x.*")
    lines = cut(named(rows, "h1", "h2").select("d", "l", "o", "w", "name"))
    levels = [lines.select("d", "l", "name")]
    runs = cut(shortest_runs(lines, min_words))
    longest = runs.agg(F.max("n")).first()[0] or 1
    while 2 ** len(levels) <= longest:
        levels.append(cut(doubled(levels[-1], 2 ** (len(levels) - 1))))
    names = levels[0].withColumn("k", F.lit(0))
    for k, level in enumerate(levels[1:], 1):
        names = names.unionByName(level.withColumn("k", F.lit(k)))
    depth = runs.withColumn("k", F.floor(F.log2("n") + 1e-9).cast("int"))
    head = names.select("d", F.col("l").alias("s"), "k", F.col("name").alias("a"))
    tail = names.select("d", F.col("l").alias("e"), "k", F.col("name").alias("b"))
    both = depth.join(head, ["d", "s", "k"]).withColumn("e", F.col("s") + F.col("n") - F.expr("shiftleft(1, k)")).join(tail, ["d", "e", "k"])
    both = cut(both.select("d", F.col("s").alias("l"), "n", "a", "b"))
    copies = named(both, "n", "a", "b").where(F.col("name") < place(F.col("d"), F.col("l")))
    gone = copies.select("d", F.explode(F.sequence(F.col("l"), F.col("l") + F.col("n") - 1)).alias("l")).distinct()
    marked = gone.join(lines.select("d", "l", "o", "w"), ["d", "l"])
    # at most the lines of one text
    per_doc = marked.groupBy("d").agg(F.sort_array(F.collect_list("o")).alias("lines"), F.sum("w").cast("bigint").alias("words"))
    return source.select("d", "__id", "__hash").join(per_doc, "d").drop("d")


def dedup_lines(docs: DataFrame, min_words: int = 10, id: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """`docs` without the lines that are later copies; `report` adds n_lines, removed_lines and removed_words.

    Earlier means a smaller id (null first; by text hash among rows of one id), or an earlier line of the same text.
    Lines without a word are not compared and stay. A text that loses all its lines becomes empty and stays as a row; a
    null or empty text is not changed; rows that repeat both id and text are one document and get the same result; an
    empty table gives an empty result. Other columns are carried, whatever their names.
    """
    gone = copied_lines(docs, min_words, id, text).select(F.col("__id").alias("__k"), F.col("__hash").alias("__h"), F.col("lines").alias("__gone"), F.col("words").alias("__words"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[id].alias("__k"), F.xxhash64(whole(docs[text])).alias("__h"))
    joined = null_safe(packed, gone, ["__h", "__k"], "left")
    joined = joined.withColumn("__parts", F.split(whole(F.col("__row").getField(text)), "\n"))
    value = F.col("__row").getField(text)
    kept = F.array_except(indices(F.size("__parts")), F.col("__gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col("__parts"), i)), "\n")
    columns = [F.when(F.col("__gone").isNotNull(), rest).otherwise(value).alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in docs.columns]
    if report:
        columns += [
            F.size("__parts").cast("bigint").alias("n_lines"),
            F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint").alias("removed_lines"),
            F.coalesce("__words", F.lit(0)).cast("bigint").alias("removed_words"),
        ]
    return joined.select(*columns)
