"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the failure bits and the
measurements. A policy is a versioned mask over the bits, so changing a policy, comparing
two, or asking what one rule alone costs never touches the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BLANKS, WORD_CHAR, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the measurements; it must be true exactly when the rule rejects."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "few_letters", "10 * n_letters < 5 * word_chars"),
    Rule(6, "shouting", "10 * n_marks > 3 * n_words"),
)
BASE_RULES = ("too_few_words", "repeated_windows")
#: Versioned policies: the rules that count.
POLICIES = {
    "base": BASE_RULES,
    "v1": ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "few_letters"),
    "v2": tuple(rule.name for rule in RULES),
    # One repeated header fails repeated_lines in a clean text of three lines; pages that mostly repeat fail by their windows.
    "v3": tuple(rule.name for rule in RULES if rule.name != "repeated_lines"),
}
#: The digest's policy, as its SQL has it, and the one by which documents are thrown out.
PRODUCTION, FILTER = "v2", "v3"


def mask(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of a policy; an unknown version or rule raises KeyError."""
    bits = {rule.name: 1 << rule.bit for rule in rules}
    return sum(bits[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def _removed(text: Column, gone: str) -> Column:
    """How many characters of `gone` the text has."""
    return (F.length(text) - F.length(F.translate(text, gone, ""))).cast("long")


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measurements): one row per input row, all arrays local to the row.

    A null text counts as empty: every measurement is 0. Repeated rows and null keys stay.
    Windows are compared by 64-bit hash inside one document, and the repeated ones are
    found by sorting, so a very long text costs n log n.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col(key).alias(key), text.alias("t")).select(key, "t", words(F.col("t")).alias("w"), F.split("t", "\n").alias("l"))
    d = d.select(key, "t", "w", F.size("w").alias("n"), F.expr(f"filter(l, x -> x rlike r'{WORD_CHAR}')").alias("l"))
    d = d.withColumn("g", F.expr("case when n < 4 then cast(array() as array<struct<h: bigint, p: int>>) else sort_array(transform(sequence(0, n - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as p))) end"))
    d = d.withColumn("p", F.expr("sort_array(transform(filter(g, (x, i) -> (i > 0 and g[greatest(i - 1, 0)].h = x.h) or (i < size(g) - 1 and g[least(i + 1, size(g) - 1)].h = x.h)), x -> x.p))"))
    # The one-row generator keeps later filters above it: pushed below, they would repeat the work of every array.
    return d.select(key, F.inline(F.array(F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", BLANKS + "+", "")).cast("long").alias("word_chars"),
        _removed(F.col("t"), SYMBOLS).alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long").alias("n_letters"),
        _removed(F.col("t"), "!").alias("n_marks"),
    ))))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """Measurements plus `failed_bits`, a bit for each rule that rejects the document."""
    bits = F.expr(" | ".join(f"(case when {rule.fails} then {1 << rule.bit}L else 0L end)" for rule in rules))
    return measure(docs, key).withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add `kept` under a policy; the texts are not read."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents it rejects, it alone rejects, and that stay without it.

    One pass with two partial sums a rule; an empty ledger gives zeros.
    """
    full = mask(policy, rules)
    active = [rule for rule in rules if full >> rule.bit & 1]
    sums = []
    for rule in active:
        bit, rest = 1 << rule.bit, full & ~(1 << rule.bit)
        sums += [F.expr(f"coalesce(sum(cast((failed_bits & {bit}L) != 0 as bigint)), 0L)").alias(f"r{rule.bit}"), F.expr(f"coalesce(sum(cast((failed_bits & {rest}L) = 0 as bigint)), 0L)").alias(f"k{rule.bit}")]
    kept = F.expr(f"coalesce(sum(cast((failed_bits & {full}L) = 0 as bigint)), 0L)").alias("kept")
    rows = ", ".join(f"'{rule.name}', r{rule.bit}, k{rule.bit} - kept, k{rule.bit}" for rule in active)
    return entries.agg(kept, *sums).select(F.expr(f"stack({len(active)}, {rows}) as (rule, n_rejected, n_rejected_alone, n_kept_without)"))


def quality_filter(docs: DataFrame, policy: str | tuple[str, ...] = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, all columns, that the policy keeps; measured in the same pass."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return apply_policy(ledger(whole, rules, "row"), policy, rules).where("kept").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    """The op1 digest: measurements, the base verdict and the production policy's verdict."""
    entries = apply_policy(ledger(docs), PRODUCTION)
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "failed_bits")


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l
  from documents),
g as (
  select *, len(w) n, case when len(w) < 3 then [] else list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]) end g from w),
x as (select row_number() over () id, * from g),
u as (select id, unnest(g) s, unnest(range(1, len(g) + 1)) p from x),
c as (select id, p, count(*) over (partition by id, s) k from u),
r as (select id, count(distinct q) rn from (select id, unnest([p, p + 1, p + 2]) q from c where k > 1) group by id),
m as (
  select x.doc_id, n::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols, len(l)::bigint n_lines,
         (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(rn, 0)::bigint n_repeat_words,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::bigint n_letters, (length(t) - length(replace(t, '!', '')))::bigint n_marks
  from x left join r using (id)),
b as (
  select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when 10 * n_dup_lines > 3 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end
    + case when 10 * n_letters < 5 * word_chars then 32 else 0 end + case when 10 * n_marks > 3 * n_words then 64 else 0 end)::bigint failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 base_failed, failed_bits = 0 kept, failed_bits from b
"""
