"""Quality rules as a bitmask ledger, with DataFrame functions only.

measure() takes every measurement once; ledger() stores them with one bit a failed rule; a *policy* is a versioned mask
of rules, applied as `fail_bits & mask = 0`; ablations() asks, for every rule of a policy, how many documents would
come back without it, from counts of the distinct masks.

Words are the runs of characters other than space and 0x09-0x0D. A null text has no words. Ties and repeated rows are
rows like others; an empty table gives an empty ledger. Columns of the input other than doc_id and text are not read,
so that clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Rules in the order of their bits, each true where a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 5 and 100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 12 * n_words",
    "shouting": "2 * n_shouted > n_words",
}
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "shouting"),
    "v2": tuple(RULES),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted"]
_SPACES = "\t\n\u000b\f\r"


def _with(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each word once.

    Windows are sorted with their positions, so that equal ones are neighbours; of the positions of those that repeat,
    in order, each covers three words less what the next one covers again.
    """

    def repeated(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

        def places(s: Column) -> Column:
            return F.filter(s, lambda x, k: (x.g == F.get(s, k - 1).g) | (x.g == F.get(s, k + 1).g))

        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a.n + F.least(F.lit(3), i - a.last)).alias("n"), i.alias("last")), lambda a: a.n)

        return _with(F.array_sort(windows), lambda s: covered(F.array_sort(F.transform(F.coalesce(places(s), F.array().cast("array<struct<g:string,i:int>>")), lambda x: x.i))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(repeated(words))


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and the measurements of every row; with carry, the row itself too, as the struct `row`."""
    also = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    kept = ["row"] if carry else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda x: F.length(F.translate(x, " " + _SPACES, "")) > 0
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *also)
    flat = base.select("doc_id", "text", *kept, F.filter(F.split(F.translate("text", _SPACES, " " * len(_SPACES)), " "), lambda x: x != "").alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    return flat.select(
        "doc_id",
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " " + _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_shouted"),
    )


def ledger(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Measurements and fail_bits: bit k is set where the k-th of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, carry).withColumn("fail_bits", out.cast("long"))


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(rule) for rule in POLICIES[policy])


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def accepted(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs, as they are, that a policy keeps.

    The bits pass through a generator, below which the filter can't move: moved down, it would evaluate every
    measurement again for each rule that uses it.
    """
    rows = ledger(docs, carry=True).select(F.inline(F.array(F.struct("row", "fail_bits"))))
    return apply_policy(rows, policy).where("kept").select("row.*")


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For every rule of a policy: documents that fail it, and those that only it rejects."""
    m = mask(policy)
    counts = rows.select(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).groupBy("bits").count()
    rules = [r for r in RULES if r in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in rules]))
    return counts.select("bits", "count", each.alias("r")).groupBy("r.rule").agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_this"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.lit(mask("base"))
    rows = apply_policy(ledger(store.table(spark, sf_dir, "documents")), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "fail_bits")


_RULE_SQL = " | ".join(f"(case when {rule} then {1 << k} else 0 end)" for k, rule in enumerate(RULES.values()))
LEDGER_SQL = rf"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    row_number() over () as r
  from documents),
g as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
d as (select r, i from g qualify count(*) over (partition by r, g) > 1),
c as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from d) group by r),
m as (
  select doc_id, cast(len(words) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len(list_filter(words, lambda x: length(x) > 1 and upper(x) = x and lower(x) <> x)) as bigint) as n_shouted
  from w left join c using (r)),
l as (select *, cast({_RULE_SQL} as bigint) as fail_bits from m)
"""
OP6_SQL = LEDGER_SQL + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask("base")}) <> 0 as base_failed,
  (fail_bits & {mask("v2")}) = 0 as kept, fail_bits
from l
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(store.table(spark, sf_dir, "documents")), "v2")


ABLATIONS_SQL = LEDGER_SQL + f"""
select rule, count(*) filter ((fail_bits & {mask("v2")} & bit) <> 0) as failed, count(*) filter ((fail_bits & {mask("v2")}) = bit) as only_this
from l, (values {", ".join(f"('{r}', cast({1 << k} as bigint))" for k, r in enumerate(RULES) if r in POLICIES["v2"])}) r(rule, bit) group by 1
"""
