"""Quality rules as a ledger of failure bits.

Each document is measured once and every rule is evaluated once; the ledger keeps the measurements
and a mask with one bit for each failed rule. A policy is a set of rules (a mask of its own) under a
version: applying another policy, or leaving one rule out, is a bitwise test of the stored masks
and reads no text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import BLANKS, bind, free_prefix, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rules that fail a document, by name; a rule's bit is its place. Only ever add at the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines",
    "capitals": "10 * n_capitals > 6 * n_letters AND n_letters >= 20",
    "exclamations": "10 * n_exclamations > 3 * n_words",
    "few_letters": "4 * n_letters < word_chars",
}


def mask_of(*names: str) -> int:
    return sum(1 << list(RULES).index(name) for name in names)


@dataclass(frozen=True)
class Policy:
    """The rules that count, as a mask; ``version`` is what decisions are recorded under."""

    version: str
    mask: int


BASE = Policy("base-1", mask_of("few_words", "repeated_words"))
STRICT = Policy("strict-1", mask_of(*RULES))


# --- measurements ----------------------------------------------------------------------------


def repeat_words(tokens: Column) -> Column:
    """The number of words that lie in a window of five found twice or more in the text.

    Windows are compared by 64-bit hash. If all differ, that is known from their number; else the
    windows are sorted by hash to find those that occur again, and what they cover is counted from
    one such window to the next.
    """
    def of_hashes(h: Column) -> Column:
        count = F.size(h) - (WINDOW - 1)
        windows = F.transform(
            F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]),
        )
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))

    def covered(w: Column) -> Column:
        order = F.array_sort(F.transform(w, lambda value, i: F.struct(value.alias("h"), i.alias("at"))))
        return bind(order, lambda s: bind(
            F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(
                (F.get(s, i - 1).h == x.h) | (F.get(s, i + 1).h == x.h), x["at"])), lambda at: at.isNotNull())),
            lambda hits: F.aggregate(
                F.transform(hits, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, k + 1) - at, F.lit(WINDOW)))),
                F.lit(0).cast("bigint"), lambda total, n: total + n),
        ))

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements, ``failed`` (a bit for each rule of ``RULES`` that fails) and nothing decided.

    Measurements: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words,
    n_letters, n_capitals, n_exclamations. All columns of ``docs`` stay; those with such a name, or
    named ``failed``, are replaced. A null text counts as empty: no words, and it fails
    ``few_words``. Each row is judged alone, in one pass, so null ids, ties and repeated rows need
    no rule, and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(without(line, BLANKS)) > 0)
    bare = without(text, BLANKS)
    at = free_prefix(docs) + "words"
    counted = bind(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("again")))
    measured = {
        "n_words": F.col(at)["n"],
        "word_chars": F.length(bare).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": F.col(at)["again"],
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")).cast("bigint"),
        "n_capitals": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("bigint"),
        "n_exclamations": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint"),
    }
    failed = F.lit(0).cast("bigint")
    for bit, test in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(F.expr(test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return docs.withColumn(at, counted).withColumns(measured).drop(at).withColumn("failed", failed)


# --- policies --------------------------------------------------------------------------------


def passes(policy: Policy, failed: str = "failed") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def apply(ledger: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a column ``kept_<version>`` for each policy."""
    return ledger.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """``rule``, ``n_failed``, ``n_only``, ``n_kept_without``: how many documents each rule of the policy rejects, how many
    it alone rejects, and how many the policy would keep without it. One pass over the stored masks, first summed by mask."""
    masks = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(name, 1 << bit) for bit, name in enumerate(RULES) if policy.mask >> bit & 1]
    sums = []
    for name, bit in rules:
        hit, only = F.col("failed").bitwiseAND(F.lit(bit)) != 0, F.col("failed") == bit
        kept = F.col("failed").bitwiseAND(F.lit(policy.mask & ~bit)) == 0
        counts = [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)) for test in (hit, only, kept)]
        sums.append(F.struct(F.lit(name).alias("rule"), *[c.alias(n) for c, n in zip(counts, ("n_failed", "n_only", "n_kept_without"))]))
    return masks.agg(F.array(*sums).alias("rules")).select(F.inline("rules"))
