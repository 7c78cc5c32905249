"""Rule bitmask ledger: every rule is evaluated once per document; policies and ablations are bit arithmetic on the ledger.

Everything here is DataFrame functions inside one row, so the ledger is a single scan without a shuffle,
whatever the skew of sources or copies.

Defined cases: a null or blank text has no words, zero measurements and fails ``few_words``; repeated rows are
judged one by one; an empty table gives an empty ledger; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
BLANK = "[\\x20\\x09-\\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a costly expression once inside a row, so that a body may use it again and again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK + "+"))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the same array, the first occurrence included."""

    def hashes(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))

    def repeated_starts(ordered: Column) -> Column:
        last = F.size(ordered) - 1

        def start(j: Column) -> Column:
            same_before = (j > 0) & (ordered[F.greatest(j - 1, F.lit(0))]["h"] == ordered[j]["h"])
            same_after = (j < last) & (ordered[F.least(j + 1, last)]["h"] == ordered[j]["h"])
            return F.when(same_before | same_after, ordered[j]["i"])

        return F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), last), start)))

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: F.least(F.lit(width), starts[k] - starts[k - 1]))
        return F.aggregate(gaps, F.lit(width).cast("long"), lambda acc, x: acc + x)

    def measured(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(let(ordered, repeated_starts), covered)
        )

    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(hashes(F.size(words)), measured))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_shouts")


def measure(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """One column of docs with the raw counts of each whole text.

    The counts leave through ``inline``, which keeps later filters from being rewritten into the costly expressions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    long = "long"

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast(long).alias("n_words"),
            F.length(F.array_join(words, "")).cast(long).alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def line_counts(kept: Column) -> Column:
        return F.struct(F.size(kept).cast(long).alias("n_lines"), (F.size(kept) - F.size(F.array_distinct(kept))).cast(long).alias("n_dup_lines"))

    found = docs.select(
        F.col(carry).alias("carried"),
        F.inline(
            F.array(
                F.struct(
                    let(words_of(text), counts).alias("w"),
                    let(lines, line_counts).alias("l"),
                    (F.length(text) - _without(text, "[#*$%&|<>]")).cast(long).alias("n_symbols"),
                    F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast(long).alias("n_letters"),
                    F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast(long).alias("n_upper"),
                    (F.length(text) - _without(text, "[!?]")).cast(long).alias("n_shouts"),
                )
            )
        ),
    )
    return found.select(F.col("carried").alias(carry), "w.*", "l.*", "n_symbols", "n_letters", "n_upper", "n_shouts").select(carry, *MEASURES)


@dataclass(frozen=True)
class Rule:
    """A named test that is true where a document fails; its place in the list is its bit."""

    name: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


#: Bits are never reused: a new rule goes to the end.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda: _c("n_words") < 10),
    Rule("repeated_windows", lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("repeated_lines", lambda: 2 * _c("n_dup_lines") > _c("n_lines")),
    Rule("word_length", lambda: (_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 12 * _c("n_words"))),
    Rule("few_letters", lambda: 10 * _c("n_letters") < 6 * _c("word_chars")),
    Rule("capitals", lambda: 2 * _c("n_upper") > _c("n_letters")),
    Rule("shouting", lambda: 4 * _c("n_shouts") > _c("n_words")),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}


def mask_of(names: Iterable[str]) -> int:
    return sum(BIT[name] for name in names)


#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base": mask_of(["few_words", "repeated_windows"]),
    "v1": mask_of(["few_words", "repeated_windows", "symbols", "repeated_lines"]),
    "v2": mask_of(BIT),
}
CURRENT = "v2"


def ledger(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """One row per document: the carried column, measurements and ``fail_bits``, bit k set where rule k fails."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.coalesce(rule.fails(), F.lit(True)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, carry).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Add base_failed and kept; no text is read again."""
    base, mask = F.lit(POLICIES["base"]).cast("long"), F.lit(POLICIES[policy]).cast("long")
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    return book.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("fail_bits").bitwiseAND(mask) == 0))


def accepted(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs, with all their columns, that the policy keeps.

    Null, empty and blank texts have too few words and go; repeated rows are decided one by one; an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), "text")
    return apply_policy(ledger(rows, "document"), policy).filter("kept").select("document.*")


def ablation(book: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy and rule: documents the rule fails, and those that only this rule of the policy fails.

    One pass of partial sums over the ledger; the result has one row per (policy, rule).
    """
    policies = POLICIES if policies is None else policies
    bits = F.col("fail_bits")
    sums, cells = [F.count(F.lit(1)).alias("n")], []
    for policy, mask in policies.items():
        sums.append(F.count_if(bits.bitwiseAND(F.lit(mask).cast("long")) != 0).alias(f"r_{policy}"))
        for name, bit in BIT.items():
            if mask & bit:
                both = bits.bitwiseAND(F.lit(mask).cast("long"))
                sums.append(F.count_if(bits.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f_{policy}_{name}"))
                sums.append(F.count_if(both == bit).alias(f"o_{policy}_{name}"))
                cells.append(
                    F.struct(
                        F.lit(policy).alias("policy"),
                        F.lit(name).alias("rule"),
                        F.col(f"f_{policy}_{name}").alias("failed"),
                        F.col(f"o_{policy}_{name}").alias("only_this"),
                        F.col(f"r_{policy}").alias("rejected"),
                        F.col("n").alias("documents"),
                    )
                )
    return book.agg(*sums).select(F.inline(F.array(*cells)))
