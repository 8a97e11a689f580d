"""Matches of regular expressions with their places, as column expressions.

A span is a struct of ``kind``, ``start``, ``stop`` (code points, end
exclusive) and ``value``.  Matches are the leftmost ones that don't overlap,
as a scan from left to right finds them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of a list that are folded at once, and code points of a piece of text: work grows with a list and a text, not with their product.
RUN, PIECE = 256, 4096
#: Type of a list of spans.
SPANS = "array<struct<kind:string,start:int,stop:int,value:string>>"


@dataclass(frozen=True)
class Kind:
    """A kind of span.

    ``pattern`` must not have two ways to match at a place, and its repeated
    groups are possessive, so that a very long run needs no deep recursion.
    ``holds`` drops matches; ``may`` is a cheap test that every text with a
    match passes.
    """

    name: str
    pattern: str
    holds: Callable[[Column], Column] | None = None
    may: Callable[[Column], Column] | None = None


def with_spans(df: DataFrame, kinds: tuple[Kind, ...], text: str = "_text") -> DataFrame:
    """``df`` with a column ``_<kind>`` of each kind's spans, null where there are none.

    In steps, so that no text is searched again for each of its matches: the
    matches; the text between them, where one holds; their places.
    """
    t, own = F.col(text), df.columns
    holds = {k.name: k.holds or (lambda m: F.lit(True)) for k in kinds}
    found = {k: F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0)) for k in kinds}
    df = df.select("*", *[(found[k] if k.may is None else F.when(k.may(t), found[k])).alias(f"_m_{k.name}") for k in kinds])
    some = {k: F.exists(f"_m_{k.name}", holds[k.name]) for k in kinds}
    df = df.select("*", *[F.when(some[k], F.split(t, k.pattern, -1)).alias(f"_g_{k.name}") for k in kinds])

    def sizes(k: Kind) -> Column:
        m = F.col(f"_m_{k.name}")
        return F.transform(m, lambda x, i: F.struct(F.length(F.get(f"_g_{k.name}", i)).alias("gap"), F.length(x).alias("size"), x.alias("value")))

    df = df.select(*own, *[F.when(F.col(f"_g_{k.name}").isNotNull(), sizes(k)).alias(f"_s_{k.name}") for k in kinds])

    def placed(k: Kind) -> Column:
        # the place of a match: the lengths of all gaps and matches before it
        def span(at: Column, x: Column) -> Column:
            start = at + x["gap"]
            one = F.array(F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + x["size"]).alias("stop"), x["value"].alias("value"))).cast(SPANS)
            return F.when(holds[k.name](x["value"]), one).otherwise(F.array().cast(SPANS))

        return scanned(F.col(f"_s_{k.name}"), lambda at, x: at + x["gap"] + x["size"], span)

    return df.select(*own, *[F.when(F.col(f"_s_{k.name}").isNotNull(), placed(k)).alias(f"_{k.name}") for k in kinds])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used, within other lists' items too."""
    return F.get(F.transform(F.array(value), use), 0)


def scanned(items: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """The spans that ``out`` gives for each item and the number before it, which starts at 0 and goes on by ``step``.

    In runs of ``RUN`` items, so that a long list isn't copied for every item.
    """
    return bound(items, lambda own: _scanned(own, step, out))


def _scanned(items: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    state = lambda at, spans_, of: F.struct(at.cast("int").alias("at"), spans_.cast(of).alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda c: F.slice(items, c * RUN + 1, RUN))

    def run(a: Column, part: Column) -> Column:
        one = lambda x, item: state(step(x["at"], item), F.concat(x["out"], out(x["at"], item)), SPANS)
        return F.aggregate(part, state(a["at"], F.array(), SPANS), one, lambda r: state(r["at"], F.concat(a["out"], F.array(r["out"])), f"array<{SPANS}>"))

    whole = F.aggregate(runs, state(F.lit(0), F.array(), f"array<{SPANS}>"), run, lambda r: F.flatten(r["out"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(SPANS))


def apart(sorted_spans: Column) -> Column:
    """Spans sorted by start, without those that begin within an earlier one that stays."""
    return scanned(
        sorted_spans,
        lambda at, s: F.when(s["start"] >= at, s["stop"]).otherwise(at),
        lambda at, s: F.when(s["start"] >= at, F.array(s).cast(SPANS)).otherwise(F.array().cast(SPANS)),
    )


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` on, of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    inner = (start - first * PIECE).cast("int")
    near = F.slice(parts, first + 1, F.floor((inner + F.greatest(size, F.lit(0))) / PIECE).cast("int") + 1)
    return F.substring(F.array_join(near, ""), inner + 1, size)


def all_spans(*lists: Column) -> Column:
    """Lists joined in the order given; null lists count as empty."""
    empty = F.array().cast(SPANS)
    return F.concat(*[F.coalesce(x, empty) for x in lists])


def by_start(spans_: Column, order: tuple[str, ...]) -> Column:
    """Sorted by start, then by kind as listed."""
    ranks = F.array(*[F.lit(k) for k in order])
    keyed = F.transform(spans_, lambda s: F.struct(s["start"].alias("at"), F.array_position(ranks, s["kind"]).alias("rank"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def counted(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans_: Column, label: Callable[[Column], Column]) -> Column:
    """The text with each span replaced by its label; of overlapping spans the first to start wins, then the longest."""
    ordered = F.transform(F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s.alias("s")))), lambda o: o["s"])
    done = bound(F.struct(pieces(text).alias("parts"), apart(ordered).alias("kept")), lambda x: _replaced(x, F.length(text), label))
    return F.when(F.size(spans_) > 0, done).otherwise(text)


def _replaced(x: Column, size: Column, label: Callable[[Column], Column]) -> Column:
    stop = lambda i: F.coalesce(F.get(x["kept"], i - 1)["stop"], F.lit(0))
    body = F.transform(x["kept"], lambda s, i: F.concat(cut(x["parts"], stop(i), s["start"] - stop(i)), label(s)))
    last = stop(F.size(x["kept"]))
    return F.concat(F.array_join(body, ""), cut(x["parts"], last, size - last))
