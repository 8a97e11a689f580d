"""Quality rules with a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the failed
rules as bits beside the measurements.  Policies are applied to the stored
bits later: changing a policy, or asking what a rule alone removes, needs no
second reading of the text.  All of it is DataFrame functions.

Edge cases: a null text counts as empty and fails ``few_words``; a null id
stays null; repeated rows give repeated rows; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: White space that ends words.
SPACE = " \t\n\x0b\f\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = r"[\x20\x09-\x0D]+"
_RUN = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, SQL over the measurements, is true."""

    name: str
    fails: str


#: Bit k of ``failed`` is rule k.  The first two are the base rules.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_words", "n_words > 100000"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "n_capitals > 30 and 100 * n_capitals > 50 * word_chars"),
    Rule("digits", "100 * n_digits > 40 * word_chars"),
    Rule("markup", "100 * n_braces > 10 * word_chars"),
    Rule("ellipses", "n_lines >= 4 and 100 * n_ellipses > 30 * n_lines"),
    Rule("bullets", "n_lines >= 4 and 100 * n_bullets > 90 * n_lines"),
    Rule("stutter", "n_words >= 10 and 100 * n_stutters > 30 * n_words"),
)
#: Versions of the policy: the rules that remove a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(r.name for r in RULES),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """Bits of the named rules; an unknown name is an error."""
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column, n: Column) -> Column:
    """Words inside runs of five that the text has twice or more."""
    sizes = F.col("_size")
    order = F.col("_sorted")
    at = lambda j: F.get(order, j)
    twice = F.filter(
        F.transform(
            F.sequence(F.lit(0), sizes - 1),
            lambda j: F.when((at(j)["x"] == at(j - 1)["x"]) | (at(j)["x"] == at(j + 1)["x"]), at(j)["i"]),
        ),
        lambda p: p.isNotNull(),
    )
    return F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(-_RUN).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(_RUN), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements, one row for each row of ``docs``; the only step that reads texts."""
    df = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("_text"))
    spaced = F.length("_text") - _without(F.col("_text"), SPACE)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    df = df.select(
        "doc_id",
        "_text",
        (F.length("_text") - spaced).cast("long").alias("word_chars"),
        (F.length("_text") - _without(F.col("_text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_text") - _without(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length("_text") - _without(F.col("_text"), "0123456789")).cast("long").alias("n_digits"),
        (F.length("_text") - _without(F.col("_text"), "{}[]\\=")).cast("long").alias("n_braces"),
        F.when(F.col("_text").contains("\n"), lines).alias("_lines"),
        F.btrim(F.col("_text"), F.lit(SPACE)).alias("_trimmed"),
    )
    df = df.select(
        *[c for c in df.columns if c not in ("_text", "_lines", "_trimmed")],
        F.coalesce(F.size("_lines"), (F.length("_trimmed") > 0).cast("int")).cast("long").alias("n_lines"),
        F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("..."))), F.lit(0)).cast("long").alias("n_ellipses"),
        F.coalesce(F.size(F.filter("_lines", lambda x: F.ltrim(x).rlike(r"^[-*•] "))), F.lit(0)).cast("long").alias("n_bullets"),
        F.when(F.length("_trimmed") > 0, F.transform(F.split("_trimmed", _SPACES), lambda w: F.xxhash64(w))).alias("_words"),
    )
    df = df.withColumn("n_words", F.coalesce(F.size("_words"), F.lit(0)).cast("long"))
    # the sizes of lists that are null are null or -1, by a setting
    df = df.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("n_words", "n_lines", "n_ellipses", "n_bullets")})
    stutters = F.filter("_words", lambda w, i: w == F.get("_words", i - 1))
    df = df.withColumn("n_stutters", F.when(F.col("n_words") > 1, F.size(stutters)).otherwise(0).cast("long"))
    runs = F.transform(F.sequence(F.lit(0), (F.col("n_words") - _RUN).cast("int")), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(_RUN)]))
    df = df.withColumn("_runs", F.when(F.col("n_words") > _RUN, runs)).drop("_words")
    df = df.withColumn("_size", F.size("_runs"))
    again = F.size(F.array_distinct("_runs")) < F.col("_size")
    pairs = F.transform("_runs", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_runs").isNotNull() & again, F.array_sort(pairs))).drop("_runs")
    return df.withColumn("n_repeat_words", F.when(F.col("_sorted").isNotNull(), _repeated(F.col("_sorted"), F.col("_size"))).otherwise(0).cast("long")).drop("_sorted", "_size")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, whose bit k says that rule k failed."""
    df = measured(docs, id_col, text_col)
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(0).cast("long") for k, r in enumerate(rules)), F.lit(0).cast("long"))
    return df.withColumn("failed", bits)


def judged(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger with the verdict of a policy in ``kept``."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(names, rules))) == 0)


def ablation(entries: DataFrame, policy: str | tuple[str, ...] = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row a rule of the policy: documents that fail it, that only it removes, and that would be kept without it."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    whole = mask(names, rules)
    held = F.col("failed").bitwiseAND(F.lit(whole))
    counts = [F.count("*").alias("n"), F.sum((held == 0).cast("long")).alias("kept")]
    for name in names:
        bit = mask((name,), rules)
        counts += [F.sum((held.bitwiseAND(F.lit(bit)) != 0).cast("long")).alias(f"f_{name}"), F.sum((held == bit).cast("long")).alias(f"o_{name}")]
    one = entries.agg(*counts)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"f_{n}"), F.lit(0)).alias("failed"), F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("only"), F.coalesce(F.col("kept") + F.col(f"o_{n}"), F.lit(0)).alias("kept_without")) for n in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document under the current policy."""
    from .common import load

    df = judged(ledger(load(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")
