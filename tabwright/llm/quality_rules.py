"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. Its verdict is one bit of ``fail_bits``; the numbers behind it stay as columns.
Policies are versioned sets of bits, so a new policy needs no new pass over the texts: it is one ``&`` on the ledger.
Ablations (what a policy would keep without one of its rules) come from the histogram of ``fail_bits``.

Defined results: a null or empty text has no words and fails ``few_words`` only. Null ids are kept as they are; repeated rows
are judged each on its own; other columns pass through :func:`keep_good` whatever their names. Windows are compared by 64-bit
hashes inside one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import UPPER, count_of, fresh_name, quoted, spaced_words, whole

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Bits are never reused: a changed rule gets a new bit, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", lambda m: m("n_words") < 20),
    Rule(1, "repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule(2, "symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule(3, "short_words", lambda m: 10 * m("word_chars") < 32 * m("n_words")),
    Rule(4, "long_words", lambda m: m("word_chars") > 12 * m("n_words")),
    Rule(5, "repeated_lines", lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines")),
    Rule(6, "shouting", lambda m: 2 * m("n_upper") > m("word_chars")),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        by_name = {r.name: r.bit for r in RULES}
        return sum(1 << by_name[n] for n in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("web-1", ("few_words", "repeated_windows", "symbols", "repeated_lines")),
    Policy("web-2", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _repeats(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Add the number of words in windows of ``WINDOW`` words that occur twice or more in the text.

    Window hashes are compared as a set first. Only documents with a repeat sort them.
    """
    hashes, windows, ordered, starts = (f"{words}_{x}" for x in ("h", "w", "o", "s"))
    h, n = F.col(hashes), F.size(words)
    docs = docs.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    docs = docs.withColumn(
        windows,
        F.when(
            n > WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
        ),
    )
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    docs = docs.withColumn(
        ordered, F.when(repeated, F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    )
    o = F.col(ordered)
    docs = docs.withColumn(
        starts,
        F.array_sort(
            F.transform(
                F.filter(o, lambda e, k: (F.get(o, k - 1)["x"] == e["x"]) | (F.get(o, k + 1)["x"] == e["x"])), lambda e: e["i"]
            )
        ),
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return docs.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop(hashes, windows, ordered, starts)


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with one column per measure and ``fail_bits``, each named ``prefix`` + name. No shuffle."""
    name = prefix.__add__
    body, words, lines = fresh_name(docs, f"{prefix}body"), fresh_name(docs, f"{prefix}words"), fresh_name(docs, f"{prefix}lines")
    s = F.col(body)
    out = docs.withColumn(body, whole(F.col(quoted(text)))).withColumn(words, spaced_words(s))
    out = out.withColumn(lines, F.filter(F.split(s, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns(
        {
            name("n_words"): F.size(words).cast("long"),
            name("word_chars"): F.length(s).cast("long") - count_of(s, " \t\n\x0b\x0c\r"),
            name("n_symbols"): count_of(s, SYMBOLS),
            name("n_lines"): F.size(lines).cast("long"),
            name("n_dup_lines"): (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            name("n_upper"): count_of(s, UPPER),
        }
    )
    out = _repeats(out, words, name("n_repeat_words")).drop(body, words, lines)
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(lambda m: F.col(name(m))), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return out.withColumn(name("fail_bits"), bits)


def passes(policy: Policy, fail_bits: str = "fail_bits") -> Column:
    return F.col(fail_bits).bitwiseAND(F.lit(policy.mask)) == 0


def failed_rules(fail_bits: str = "fail_bits") -> Column:
    """The names behind the bits."""
    return F.array_compact(
        F.array(*[F.when(F.col(fail_bits).bitwiseAND(F.lit(1 << r.bit)) != 0, F.lit(r.name)) for r in RULES])
    )


def ablation(found: DataFrame, policies: tuple[Policy, ...] = POLICIES, fail_bits: str = "fail_bits") -> DataFrame:
    """For each policy and rule: documents that the policy keeps, that it would keep without the rule, that only this rule rejects.

    Works on the histogram of ``fail_bits``, which has at most 2 ** rules rows; the ledger itself is read once. Bits of an
    empty ledger give no rows.
    """
    counts = found.groupBy(F.col(fail_bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    cases = F.explode(
        F.array(
            *[
                F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
                for p in policies for r in RULES if r.name in p.rules
            ]
        )
    )
    c = counts.select("bits", "n", cases.alias("c")).select("bits", "n", "c.*")
    of = F.col("bits").bitwiseAND(F.col("mask"))
    without = F.col("bits").bitwiseAND(F.col("mask") - F.col("bit"))
    return c.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(of == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(of == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
    )


def keep_good(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass ``policy``, with their own columns."""
    prefix = fresh_name(docs, "quality")
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    # A filter on measures would have them computed anew inside it, once per array element. The optimizer leaves a filter above a
    # projection that isn't deterministic, and the row number, which is never negative, makes it so.
    row = f"{prefix}row"
    out = ledger(docs, text, prefix).withColumn(row, F.monotonically_increasing_id())
    out = out.filter(passes(policy, f"{prefix}fail_bits") & (F.col(row) >= 0))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def assess(docs: DataFrame, policy: Policy = CURRENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: id, measures, bits, and the verdicts of the base policy and of ``policy``."""
    found = ledger(docs.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text")))
    return found.select(
        "doc_id", *MEASURES, "fail_bits", (~passes(BASE)).alias("base_failed"),
        (passes(BASE) & passes(policy)).alias("kept"), F.lit(policy.version).alias("policy"),
    )
