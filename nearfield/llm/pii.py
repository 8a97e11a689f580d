"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is DataFrame functions; no shuffle.  Every kind has a prior, a
validator raises it, words of the kind near the span raise it, and words that
mark examples lower it.  The base kinds (email, ip, card, phone) are always
reported; the further kinds (iban, by mod-97, and national, by its form) only
from ``THRESHOLD`` on.  An account number has the length of its country, so
that words and numbers after it stay outside.

Edge cases: a null text counts as empty, and an empty one has no spans; a very
long text is searched whole, in time that grows with its length and its matches;
spans of one kind are ordered by start, and those of two kinds at one place by
kind as listed; a null id stays null; repeated rows give repeated rows; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha, load, text_of
from .spans import SPANS, Kind, all_spans, apart, counted, cut, joined, masked, pieces, with_spans

_LOCAL = "A-Za-z0-9._%+-"
_DIGITS = r"[0-9]"


def _digits(m: Column) -> Column:
    return F.translate(m, "+ ().-", "")


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)


def _luhn(m: Column) -> Column:
    d = F.translate(m, " -", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _mod97(m: Column) -> Column:
    """The account number's check: its first four characters moved to the end, letters as 10 to 35, leave 1."""
    s = F.translate(m, " ", "")
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike(_DIGITS), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    rest = F.aggregate(chars, F.lit(0), lambda a, c: (F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97).cast("int"))
    return F.length(s).between(15, 34) & (rest == 1)


#: Countries by the characters of their account numbers: the registry's, and those that use the form without being in it.
_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "IR IS TR DZ",
    27: "BI CF CG CM DJ FR GR IT KM MC MG SM TD GA GQ",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
#: An account number at the start of a text, of its country's length; no others are issued.
_ACCOUNT = (
    "^(?:"
    + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
    + ")(?![A-Za-z0-9])"
)
#: Code points that an account number, its single spaces and the character after it take at most.
_ACCOUNT_CHARS = 68


def _accounts(parts: Column, heads: Column) -> Column:
    """The account numbers that hold among those that begin at the heads; of overlapping ones the first."""
    value = lambda s: F.regexp_extract(cut(parts, s["start"], F.lit(_ACCOUNT_CHARS)), _ACCOUNT, 0)
    whole = F.transform(heads, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), value(s).alias("value")))
    sure = F.transform(F.filter(whole, lambda s: _mod97(s["value"])), lambda s: F.struct(s["kind"], s["start"], (s["start"] + F.length(s["value"])).alias("stop"), s["value"])).cast(SPANS)
    return apart(sure)


#: A match begins where a run of local characters begins or where the last match ended, which keeps long runs linear.
BASE = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", may=lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _small_parts, may=lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", _luhn, may=lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), may=lambda t: t.contains("+")),
)
FURTHER = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})", may=lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), may=lambda t: t.rlike("[0-9]{3}-[0-9]{2}-")),
)
KINDS = BASE + FURTHER
#: Before any context; kinds with a checksum have proved more.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national": 0.3}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "reply"),
    "ip": ("address", "server", "host", "login", "client"),
    "card": ("card", "visa", "master", "credit", "debit", "payment", "expir"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "tax", "national"),
}
#: Words near a span that speak against it.
AGAINST = ("example", "sample", "dummy", "test", "version", "isbn", "placeholder")
#: Code points on either side that count as near.
NEAR = 40
RAISE, LOWER, THRESHOLD = 0.25, 0.3, 0.5


def _score(parts: Column, s: Column) -> Column:
    from_ = F.greatest(s["start"] - NEAR, F.lit(0))
    near = F.lower(F.concat(cut(parts, from_, s["start"] - from_), F.lit(" "), cut(parts, s["stop"], F.lit(NEAR))))
    prior, bonus = F.lit(0.0), F.lit(False)
    for k in KINDS:
        prior = F.when(s["kind"] == k.name, F.lit(PRIOR[k.name])).otherwise(prior)
        bonus = F.when(s["kind"] == k.name, near.rlike("|".join(CONTEXT[k.name]))).otherwise(bonus)
    score = prior + F.when(bonus, RAISE).otherwise(0.0) - F.when(near.rlike("|".join(AGAINST)), LOWER).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def found(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``_text``, ``spans`` (by kind, then start) and ``scores`` in the same order."""
    df = docs.select(*[docs[c] for c in keep], text_of(docs, text_col).alias("_text"))
    df = with_spans(df, KINDS)
    some = F.coalesce(*[F.col(f"_{k.name}") for k in KINDS]).isNotNull()
    df = df.withColumn("_parts", F.when(some, pieces(F.col("_text"))))
    df = df.withColumn("_iban", F.when(F.col("_iban").isNotNull(), _accounts(F.col("_parts"), F.col("_iban"))))
    rows = all_spans(*[F.col(f"_{k.name}") for k in KINDS])
    scored = F.transform(rows, lambda s: F.struct(s.alias("span"), _score(F.col("_parts"), s).alias("score")))
    df = df.select(*keep, "_text", scored.alias("_scored"))
    base = [k.name for k in BASE]
    held = F.filter("_scored", lambda x: x["span"]["kind"].isin(base) | (x["score"] >= THRESHOLD))
    df = df.select(*keep, "_text", held.alias("_scored"))
    return df.select(*keep, "_text", F.transform("_scored", lambda x: x["span"]).alias("spans"), F.transform("_scored", lambda x: x["score"]).alias("scores"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """doc_id and the text with every span of that score or more replaced by its kind in brackets."""
    df = found(docs, text_col, (id_col,))
    sure = F.transform(F.filter(F.arrays_zip("spans", "scores"), lambda z: z["scores"] >= least), lambda z: z["spans"])
    return df.select(F.col(id_col).alias("doc_id"), masked(F.col("_text"), sure, lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("text"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    names = [k.name for k in BASE]
    df = found(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(names))
    return df.select(
        "doc_id",
        *[counted(F.col("spans"), n).alias(f"n_{n}") for n in names],
        hex_sha(joined(base)).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[counted(F.col("spans"), k.name).alias(f"n_{k.name}") for k in FURTHER],
        F.size(F.filter("scores", lambda x: x >= THRESHOLD)).cast("long").alias("n_likely"),
        F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"),
    )
