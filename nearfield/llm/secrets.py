"""Secrets, with the ownership of every candidate over the whole corpus.

Patterns find candidates; the hash of each candidate is counted over distinct
repositories and owners.  A value that many owners or many repositories hold is
a copied example; a random-looking value of one owner is live-looking.  Values themselves never
leave their row: only hashes are shuffled, aggregated to one row per owner
before owners are counted.

Edge cases: a null text counts as empty, and an empty one has no spans; a very
long text is searched whole, in time that grows with its length and its matches;
spans that begin together are ordered by kind as listed; a private
key without its last line ends where the key's lines end, and one without a body
is a stand-in; a null repository or owner is one of its own; a null id stays null; repeated rows
give repeated rows, and count once as a repository; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha, load, text_of, written
from .spans import Kind, all_spans, by_start, counted, joined, masked, with_spans

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?"

_BEGIN, _END = (rf"-----{w} [A-Z ]{{0,40}}PRIVATE KEY-----" for w in ("BEGIN", "END"))
#: What follows a private key's first line where its last one is missing: lines of the key's characters, long runs of them, header lines, and what the text ends within.
_OPEN = r"(?:(?:\s|\\[nr])*+(?:[A-Za-z0-9+/=]{20,}+|(?:Proc-Type|DEK-Info):[^\r\n]*+)|[\x20\t]*+[\r\n]\s*+[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n]|\z)))*+(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]++\s*+\z)?+"

BASE = (
    Kind("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]++", lambda m: F.length(_value(m)) >= 6, may=lambda t: t.rlike("(?i)passw|secret|token|api_?key")),
    Kind("access", r"AKIA[A-Z0-9]++", lambda m: F.length(m) >= 20, may=lambda t: t.contains("AKIA")),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", may=lambda t: t.rlike("[0-9a-f]{24}")),
)
FURTHER = (
    Kind("pem", _BEGIN + r"(?:[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+" + _END + "|" + _OPEN + ")", may=lambda t: t.contains("PRIVATE KEY")),
    Kind("signed", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", may=lambda t: t.contains("eyJ")),
)
KINDS = BASE + FURTHER
ORDER = tuple(k.name for k in KINDS)
#: A value that this many owners hold is a copied example.
EXAMPLE_OWNERS = 3
#: So is a value in this many repositories, however few owners they have.
EXAMPLE_REPOS = 10
#: Distinct characters that a live-looking value has at least.
LEAST_CHARS = 6
#: Values that stand for others.
STANDINS = r"(?i)example|changeme|your[-_]|placeholder|xxxx|dummy|^(.)\1*$|^-----BEGIN$"
#: Characters from which on a private key holds the words of ``STANDINS`` by chance only.
KEY_CHARS = 64


def _value(match: Column) -> Column:
    """What an assignment assigns."""
    return F.regexp_replace(match, "^" + _ASSIGN, "")


def _body(match: Column) -> Column:
    """A private key between its first and last line, however its lines are broken."""
    return F.regexp_replace(match, rf"{_BEGIN}|{_END}|\s|\\[nr]", "")


def _secret(span: Column) -> Column:
    """The value that counts: of an assignment what it assigns, of a private key its body, of other kinds the match."""
    return F.when(span["kind"] == "assign", _value(span["value"])).when(span["kind"] == "pem", _body(span["value"])).otherwise(span["value"])


def found(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``_text``, ``_repo``, ``_owner`` and ``spans`` by start; no shuffle."""
    df = docs.select(*[docs[c] for c in keep], text_of(docs, text_col).alias("_text"), docs[repo_col].cast("string").alias("_repo"), docs[owner_col].cast("string").alias("_owner"))
    df = with_spans(df, KINDS)
    # nested spans of one value (an assigned hex string) are both kept
    return df.select(*keep, "_text", "_repo", "_owner", by_start(all_spans(*[F.col(f"_{k.name}") for k in KINDS]), ORDER).alias("spans"))


def _hash(span: Column) -> Column:
    return F.unhex(F.sha2(_secret(span), 256))


def ownership(candidates: DataFrame) -> DataFrame:
    """One row a candidate hash: its distinct repositories and owners.

    ``candidates`` has hash, repo and owner.  A value that a third of all rows
    hold is first reduced to one row a repository in each task.  Repositories
    are counted within an owner, then over owners: a repository belongs to one.
    """
    once = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    held = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return held.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def classified(rows: DataFrame) -> DataFrame:
    """One row a span (``key``, ``span``, ``repo``, ``owner``), with ``hash``, ``n_repos``, ``n_owners`` and ``verdict``: example, standin, live or unsure."""
    flat = rows.withColumn("hash", _hash(F.col("span")))
    known = ownership(flat.select("hash", "repo", "owner"))
    value = _secret(F.col("span"))
    named = value.rlike(STANDINS) & ((F.col("span.kind") != "pem") | (F.length(value) < KEY_CHARS))
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARS
    verdict = (
        F.when((F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repos") >= EXAMPLE_REPOS), "example")
        .when(named | ~varied, "standin")
        .when(F.col("n_owners") == 1, "live")
        .otherwise("unsure")
    )
    return flat.join(known, "hash").withColumn("verdict", verdict)


def scanned(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ``spans`` by start, and counts of spans by verdict: n_live, n_example, n_standin, n_unsure; most_owners and most_repos of one span."""
    rows = found(docs, repo_col, owner_col, text_col, (id_col,)).drop("_text").withColumnRenamed(id_col, "doc_id")
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "secrets")
    flat = rows.select("key", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), F.explode("spans").alias("span"))
    per = classified(flat).groupBy("key").agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example", "standin", "unsure")], F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    out = rows.join(per, "key", "left").drop("key", "_repo", "_owner")
    return out.na.fill(0, ["n_live", "n_example", "n_standin", "n_unsure", "most_owners", "most_repos"])


def redacted(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns; live-looking values are replaced by their kind in brackets.

    ``length_col`` names a column with the text's length, which follows.  The
    texts are read twice, and only verdicts are joined.
    """
    rows = found(docs, repo_col, owner_col, text_col, (repo_col,))
    key = F.xxhash64("_repo", "_owner", "_text").alias("key")
    keyed = rows.select(key, F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), "spans")  # the text is hashed once, not for each span
    # a filter on the spans, which a plain explode implies, would search every text a second time
    flat = written(keyed.select("key", "repo", "owner", F.explode_outer("spans").alias("span")).where(F.col("span").isNotNull()), "secrets").distinct()
    live = classified(flat).where(F.col("verdict") == "live").groupBy("key").agg(F.collect_list("span").alias("_live"))
    live = live.withColumnRenamed("key", "_key")
    text = text_of(docs, text_col)
    out = docs.join(live, F.xxhash64(docs[repo_col].cast("string"), docs[owner_col].cast("string"), text) == F.col("_key"), "left")
    some = F.col("_live").isNotNull()
    new = masked(text, F.col("_live"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    changed = {text_col: F.when(some, new).otherwise(docs[text_col])}
    if length_col:
        changed[length_col] = F.when(some, F.length(new)).otherwise(docs[length_col]).cast(docs.schema[length_col].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the ownership of its candidates."""
    df = scanned(load(spark, sf_dir, "documents"))
    names = [k.name for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return df.select(
        "doc_id",
        *[counted(F.col("spans"), n).alias(f"n_{n}") for n in names],
        hex_sha(joined(base)).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        "n_standin",
        "n_unsure",
        "most_owners",
        "most_repos",
    )
