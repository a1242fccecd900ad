"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds the measurements and one bit per failed rule; policies
are masks over those bits, so another policy or an ablation never reads a text again.

Everything is column expressions in one narrow pass: no shuffle, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicelake.llm.common import indices, once, whole, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"

#: Rule name -> failure, in terms of the measurements. The position in this table is the bit; add rules at the end only.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "capitals": "n_letters >= 50 AND 10 * n_capitals > 6 * n_letters",
}
#: Version -> the rules that reject a document. `base` holds the rules that every policy includes.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v2": tuple(RULES),
}
LATEST = "v2"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measure(text: Column) -> Mapping[str, Column]:
    """The measurements that need only the text (no shared arrays)."""
    t = whole(text)
    return {
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
        "n_capitals": F.length(F.regexp_replace(t, CAPITALS.replace("[", "[^", 1), "")).cast("bigint"),
        "n_letters": F.length(F.regexp_replace(t, LETTERS.replace("[", "[^", 1), "")).cast("bigint"),
    }


def ledger(docs: DataFrame, text: str = "text", window: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns, the measurements and `fail_bits` of each document, one row per row.

    A null or empty text has no words and fails `few_words`; identical rows get identical ledger rows; a text shorter than
    the window has no repeated words. Columns of `docs` that are not in `keep` are not carried. Window hashes are 64 bits:
    two different windows of one text would have to collide to change a count.
    """
    t = F.col("__t")
    work = docs.select(*[F.col(c) for c in keep], whole(F.col(text)).alias("__t"))
    work = work.select(*keep, "__t", words_of(t).alias("__w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    work = work.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    hashes = F.col("__h")
    grams = F.transform(
        indices(F.size(hashes) - (window - 1)),
        lambda i: F.struct(F.xxhash64(*[hashes[i + k] for k in range(window)]).alias("h"), i.alias("i")),
    )
    work = work.withColumn("__g", F.sort_array(grams))
    g, last = F.col("__g"), F.size("__g") - 1
    equal = lambda j, k: g[j]["h"] == g[k]["h"]
    starts = F.filter(indices(F.size(g)), lambda j: ((j > 0) & equal(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & equal(j, F.least(j + 1, last))))
    work = work.withColumn("__s", F.sort_array(F.transform(starts, lambda j: g[j]["i"])))
    s = F.col("__s")
    covered = F.aggregate(
        indices(F.size(s)),
        F.lit(0),
        lambda total, j: total + F.when(j + 1 < F.size(s), F.least(F.lit(window), s[F.least(j + 1, F.size(s) - 1)] - s[j])).otherwise(F.lit(window)),
    )
    measured = work.select(
        *keep,
        F.size("__w").cast("bigint").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        once(covered.cast("bigint")).alias("n_repeat_words"),
        *[c.alias(n) for n, c in measure(t).items()],
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("fail_bits", once(bits.cast("bigint")))


def passes(policy: str = LATEST, bits: str = "fail_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents that only it fails (kept again without it).

    The ledger shrinks to one row per bit pattern with partial sums before the rules are spread over it: at most
    2**rules rows whatever the corpus.
    """
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << names.index(rule)).cast("bigint").alias("bit")) for rule in POLICIES[policy]])
    spread = patterns.select("bits", "n", F.inline(each))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return spread.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
    )


def keep_good(docs: DataFrame, policy: str = LATEST, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass the policy, with their columns as they are."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[text].alias("__text"))
    kept = ledger(packed, "__text", keep=("__row",)).where(passes(policy))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
