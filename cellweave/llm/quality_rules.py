"""Quality rules as a ledger of failure bits: measure once, judge by any policy later."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import SPACES

SYMBOLS = r"[#*$%&|<>]"

#: name -> condition that fails a document, over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "odd_word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "few_distinct_words": "n_words >= 50 and 20 * n_distinct_words < n_words and n_distinct_words < 50",
    "shouting": "n_letters >= 50 and 2 * n_upper > n_letters",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_distinct_words", "n_letters", "n_upper", "n_repeat_words")
#: Versioned policies: the rules that reject.
POLICIES: dict[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask_of(policy: str | Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements to ``docs``; columns of their names are replaced.

    ``n_repeat_words`` counts words inside three-word windows that occur twice or more.  A window's
    64-bit hash, with its place in the low bits, is sorted, so that equal windows are neighbours;
    neighbours are confirmed by the whole hash.  Everything happens inside the row: no shuffle.
    """
    own = list(MEASURES)
    kept = [c for c in docs.columns if c not in own]
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACES, -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    step = docs.select(*kept, words.alias("_w"), lines.alias("_lines"),
                       F.regexp_count(body, F.lit(SYMBOLS)).alias("n_symbols"),
                       F.regexp_count(body, F.lit(r"\p{L}")).alias("n_letters"), F.regexp_count(body, F.lit(r"\p{Lu}")).alias("n_upper"))
    step = step.select(
        *kept, "n_symbols", "n_letters", "n_upper", "_w", F.size("_w").alias("n_words"), F.length(F.array_join("_w", "")).alias("word_chars"),
        F.size("_lines").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).alias("n_distinct_words"),
        F.expr("if(size(_w) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size(_w) - 3, 0)), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))").alias("_h"))
    # documents whose windows all differ need no sorting
    place = F.expr("cast(length(bin(size(_h))) as int)")
    step = step.withColumn("_b", place).withColumn("_sorted", F.expr(
        "if(size(array_distinct(_h)) = size(_h), cast(array() as array<bigint>), sort_array(transform(_h, (h, i) -> shiftleft(h, _b) | i)))"))
    step = step.withColumn("_at", F.expr(
        "transform(_sorted, k -> cast(k & (shiftleft(1L, _b) - 1) as int))"))
    step = step.withColumn("_again", F.expr(
        "sort_array(filter(transform(_at, (p, j) -> if((j > 0 and _h[_at[greatest(j - 1, 0)]] = _h[p]) or (j + 1 < size(_at) and _h[_at[least(j + 1, size(_at) - 1)]] = _h[p]), p, -1)), p -> p >= 0))"))
    covered = F.expr("aggregate(_again, named_struct('n', 0L, 'end', 0), (s, p) -> named_struct('n', s.n + p + 3 - greatest(s.end, p), 'end', p + 3), s -> s.n)")
    return step.select(*kept, *[F.col(c).cast("long").alias(c) for c in own[:-1]], covered.alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """``docs`` with measurements and ``fail_bits``: bit i is set if rule i fails the document."""
    bits = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    measured = measure(docs, text)
    measured = measured.select(*[c for c in measured.columns if c != "fail_bits"])
    kept = [c for c in measured.columns if c not in MEASURES]
    # one generated row each: a filter on the bits would else be pushed down with all measurements written into it, over and over
    return measured.select(*kept, F.inline(F.array(F.struct(*MEASURES, bits.alias("fail_bits")))))


def rejects(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) != 0


def apply_policies(book: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Add ``kept_<policy>`` for each policy to a ledger; no rule is evaluated again."""
    return book.select("*", *[(~rejects(mask_of(names, rules))).alias(f"kept_{name}") for name, names in policies.items()])


def ablations(book: DataFrame, policy: str | Sequence[str] = "v1", rules: Mapping[str, str] = RULES) -> DataFrame:
    """(rule, failed, only, kept_without) for each rule of a policy, from counts of the distinct bit sets.

    ``failed``: documents that fail the rule; ``only``: those that fail no other rule of the policy and
    would be kept without it; ``kept_without``: what the policy without this rule keeps.
    """
    mask, names = mask_of(policy, rules), list(rules)
    sets = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in names if mask >> names.index(r) & 1]
    each = sets.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in chosen])))
    bit, count = F.col("rule.bit"), lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("rule.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(bit) != 0).alias("failed"), count(F.col("bits") == bit).alias("only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without"))


def keep(docs: DataFrame, text: str = "text", policy: str | Sequence[str] = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns, whatever these are called."""
    body = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    return ledger(body, "_text").filter(~rejects(mask_of(policy))).select("_row.*")
