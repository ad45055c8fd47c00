"""Quality rules as a bitmask ledger: every rule is measured once, policies read the bits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` is a condition over the measurements; its position in RULES is its bit."""

    name: str
    failed: Callable[[], Column]


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: Bits never change their meaning; new rules are appended.
RULES = [
    Rule("few_words", lambda: F.col("n_words") < 10),
    Rule("repeated_words", lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
    Rule("symbols", lambda: _share("n_symbols", "n_words") > 0.1),
    Rule("duplicate_lines", lambda: _share("n_dup_lines", "n_lines") > 0.35),
    Rule("long_words", lambda: _share("word_chars", "n_words") > 12),
    Rule("short_words", lambda: _share("word_chars", "n_words") < 2.5),
    Rule("capitals", lambda: _share("n_capitals", "word_chars") > 0.4),
    Rule("few_letters", lambda: _share("n_digits", "word_chars") > 0.5),
]
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.  Versions stay as they are.
POLICIES = {
    "base-1": ["few_words", "repeated_words"],
    "web-1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "web-2": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words", "capitals", "few_letters"],
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_digits"]


def policy_mask(policy: str) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def measured(rows: DataFrame, text: str) -> DataFrame:
    """Adds the measurements of ``MEASURES`` (long) to ``rows``; null text counts as empty.

    Each step is a projection over the columns of the one before, arrays are zipped rather
    than indexed, so no expression is evaluated per element more than once.  Positions of
    repeated windows are found by sorting window hashes inside the row; texts without a
    repeated window skip that.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim("_t", F.lit(SPACES))
    rows = rows.withColumn("_t", t).withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_t", SPACES, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_capitals": F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")).cast("long"),
        "n_digits": (F.length("_t") - F.length(F.translate("_t", "0123456789", ""))).cast("long"),
        "_lines": F.filter(F.split("_t", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
    }).drop("_t", "_words")
    n = F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_h", F.lit(i + 1), n).alias(f"w{i}") for i in range(WINDOW)])
    rows = rows.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.transform(zipped, lambda z: F.xxhash64(z)),
    }).drop("_lines", "_h")
    count = F.size("_windows")
    placed = F.array_sort(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(1), count).alias("at")))
    rows = rows.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < count, placed)).drop("_windows")
    shifted = F.concat(F.array(F.lit(None).cast(rows.schema["_placed"].dataType.elementType)), F.col("_placed"))
    ahead = F.slice("_placed", 2, F.greatest(F.size("_placed"), F.lit(1)))
    trio = F.arrays_zip(F.col("_placed").alias("a"), F.slice(shifted, F.lit(1), F.greatest(F.size("_placed"), F.lit(0))).alias("b"), ahead.alias("c"))
    repeated = F.filter(trio, lambda z: F.coalesce(z["a"]["h"] == z["b"]["h"], F.lit(False)) | F.coalesce(z["a"]["h"] == z["c"]["h"], F.lit(False)))
    rows = rows.withColumn("_at", F.when(F.col("_placed").isNotNull(), F.array_sort(F.transform(repeated, lambda z: z["a"]["at"])))).drop("_placed")
    pairs = F.arrays_zip(F.col("_at").alias("a"), F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))).alias("b"))
    covered = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, z: s + F.coalesce(F.least(z["b"] - z["a"], F.lit(WINDOW)), F.lit(WINDOW)))
    return rows.withColumn("n_repeat_words", F.when(F.col("_at").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("_at")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every document with its measurements and ``failures``, one bit per failed rule.

    The documents' own columns travel in the struct ``document``, so names cannot clash.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("document"), docs[text_col].cast("string").alias("_text"))
    rows = measured(rows, "_text").drop("_text")
    # a generator stops filters and projections on their way down, which would repeat each measurement inside the next
    rows = rows.select("document", F.inline(F.array(F.struct(*[c for c in rows.columns if c != "document"]))))
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(rule.failed(), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long")
    return rows.withColumn("failures", bits)


def kept(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def passing(docs: DataFrame, policy: str, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return ledger(docs, text_col).where(kept(policy)).select("document.*")


def ablations(book: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """For each policy and rule: documents failing the rule, rejected by the policy, and
    rejected by this rule alone (they would come back without it).  Documents are first
    counted per distinct mask, which the shuffle combines to 2^rules rows at most."""
    masks = book.groupBy("failures").agg(F.count("*").alias("n"))
    cells = [
        F.struct(F.lit(p).alias("policy"), F.lit(policy_mask(p)).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"))
        for p in (policies or POLICIES) for r in POLICIES[p]
    ]
    rows = masks.select("*", F.inline(F.array(*cells)))
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    return rows.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failures").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_here"),
    )
