"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target gives every document of it the same number of copies on
average, a whole part and a fraction.  The fractions are inclusion
probabilities.  A flight moves them through the null space of the balancing
constraints (documents and words of the source), three undecided documents at
a time, until at most two are left; each step decides one.  Flights run in
blocks of a bounded number of rows, then what the blocks left is dealt to blocks
and flies again, until a source's rest is a block's worth; only the last few
documents are landed by trying every outcome.  No text is shuffled: rows are an
id, a hash, a size and how often the row is there.

Edge cases: a null text has size 0, takes nothing and keeps its row; a null
source is one of its own, the last; a null id stays null; equal rows
(the same id, source and text) are counted before they are shuffled, share what
their number is due, less than one document apart, and come back as so many rows;
equal sizes are told apart by a hash; a text may be as long as memory holds, as
only its count of words goes on; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import load, text_of, written

#: A source's target is at most so many times its size, and so is a document's share.
CAP = 3
WEIGHTS = (1, 2, 3)
#: Rows that a flight takes at most, nearly: blocks are dealt by a hash.  Equal rows come back in pieces of so many.
BLOCK_ROWS = 2_000
#: Documents of a source that stay out of the flights and are landed with what those leave.
HELD = 12
SEED = 7
_NEAR = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size (words) and a hash of the row that breaks ties."""
    text = text_of(docs, text_col)
    df = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), F.xxhash64(docs[id_col], text, F.lit(SEED)).alias("h"), text.alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(tk.words(raw, off, tk.SPACED)[2]) for _, _, raw, off in tk.chunks(b.column(3))]
            size = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], size], ["doc_id", "source", "h", "size"])

    id_type = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(count, f"doc_id {id_type}, source string, h long, size long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: source, rank, source_size, n_docs (different rows), target.

    Sources in code point order weigh ``weights``, repeating.  A source gets
    its weight's share of a common level, at most ``cap`` times its size; the
    level is the one at which all targets add up to all sizes.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(order))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights))
    per = per.withColumn("w", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), "rank")
    before = F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    # sources below the level are full; the first that is not sets it
    fits = F.when(F.col("level") <= F.col("most") / F.col("w"), F.struct(F.col("most") / F.col("w"), "rank", "level"))
    level = F.min(fits).over(whole)["level"]
    target = F.least(F.col("most"), F.coalesce(level, F.lit(math.inf)) * F.col("w"))
    return per.withColumn("target", target).select("source", "rank", "source_size", "n_docs", "target")


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for at most two.

    Each step keeps the sums of ``pi`` and of ``pi * size`` over three
    undecided rows, goes up or down the only direction that does, as far as a
    row is decided, and keeps every row's expectation.
    """
    x = pi.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = iter(rng.random(len(x) + 3).tolist())
    active: list[int] = []
    for k in range(len(x)):
        if not _NEAR < x[k] < 1 - _NEAR:
            x[k] = float(round(x[k]))
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - x[i]) / v if v > 0 else x[i] / -v for i, v in zip(active, u, strict=True) if v)
        down = min(x[i] / v if v > 0 else (1 - x[i]) / -v for i, v in zip(active, u, strict=True) if v)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, v in zip(active, u, strict=True):
            x[i] += step * v
            if _NEAR < x[i] < 1 - _NEAR:
                left.append(i)
            else:
                x[i] = float(round(x[i]))
        active = left
    return np.array(x)


def landed(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the few undecided rows that comes nearest to their expected words, then documents."""
    x = pi.copy()
    open_ = np.flatnonzero((x > _NEAR) & (x < 1 - _NEAR))
    if not len(open_):
        return np.round(x)
    tries = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    off = np.abs(tries @ size[open_] - x[open_] @ size[open_])
    docs = np.abs(tries.sum(1) - x[open_].sum())
    x[open_] = tries[np.lexsort((docs, off))[0]]
    return np.round(x)


def _flown(seed: int, turn: int, last: bool = False):
    """Flies a block, all but ``HELD`` rows of a source's block 0 (marked by block -1 in turn 0); the last time, lands a source."""

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["h"].to_numpy(), -t["size"].to_numpy()))  # short documents last: what stays undecided is small
        t = t.take(pa.array(order))
        block, x, size = t["block"].to_numpy().copy(), t["x"].to_numpy().copy(), t["size"].to_numpy()
        if turn == 0 and block[0] == 0:
            block[np.argsort(t["h"].to_numpy(), kind="stable")[:HELD]] = -1
        fly = block >= 0
        x[fly] = flight(x[fly], size[fly], np.random.default_rng([seed, int(t["rank"][0].as_py()), int(block.max()) + 1, turn]))
        if last:
            x = landed(x, size)
        for name, values in (("x", x), ("block", block)):
            t = t.set_column(t.column_names.index(name), name, pa.array(values))
        return t

    return run


def _repeated(rows: DataFrame) -> DataFrame:
    """A row for each of the ``n`` equal ones, the first ``extra`` of them with a copy more; a large ``n`` is dealt over tasks."""
    chunk = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {BLOCK_ROWS}"))))
    many = chunk.where(F.col("n") > BLOCK_ROWS).repartition("h", "chunk")
    chunk = chunk.where(F.col("n") <= BLOCK_ROWS).unionByName(many)
    at = F.col("chunk") * BLOCK_ROWS
    each = chunk.withColumn("k", F.explode(F.sequence(at, F.least(at + BLOCK_ROWS, "n") - 1)))
    return each.withColumn("copies", F.col("whole") + F.when(F.col("k") < F.col("extra"), 1).otherwise(0))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and copies, how often the mix takes the document."""
    sizes = sized(docs, id_col, source_col, text_col).groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n"))
    sizes = written(sizes, "mix-sizes")
    goal = written(targets(sizes, weights, cap), "mix-targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    names = {"source": "_s"}
    df = sizes.join(goal.withColumnsRenamed(names), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    share = F.when(F.abs(share - F.round(share)) < _NEAR, F.round(share)).otherwise(share)
    df = df.withColumn("f", F.when(F.col("size") > 0, share).otherwise(0.0))
    # of n equal rows, with x each, so many take one more that less than one is left, and that flies
    df = df.withColumn("whole", F.floor("f").cast("long")).withColumn("f", (F.col("f") - F.floor("f")) * F.col("n"))
    df = df.withColumn("extra", F.floor(F.col("f") + _NEAR).cast("long")).withColumn("x", F.greatest(F.lit(0.0), F.col("f") - F.col("extra"))).drop("f")
    df = df.withColumn("block", F.lit(None).cast("long"))
    parts = [df.where(F.col("x") < _NEAR)]
    left, bound, most, turn = df.where(F.col("x") >= _NEAR), F.col("n_docs"), goal.agg(F.max("n_docs")).first()[0] or 0, 0
    undecided = F.col("x").between(_NEAR, 1 - _NEAR)
    while turn == 0 or most > BLOCK_ROWS:
        blocks = F.ceil(bound / BLOCK_ROWS)
        dealt = F.pmod(F.xxhash64("h", F.lit(turn)), blocks)
        left = left.withColumn("block", F.when(F.col("block") == -1, F.lit(-1)).otherwise(dealt))
        flown = written(left.groupBy("rank", "block").applyInArrow(_flown(seed, turn), df.schema), f"mix-flight-{turn}")
        parts.append(flown.where(~undecided))
        # at most two rows of a block are left, and those held
        left, bound, most, turn = flown.where(undecided), blocks * 2 + HELD, -(-most // BLOCK_ROWS) * 2 + HELD, turn + 1
    parts.append(written(left.groupBy("rank").applyInArrow(_flown(seed, turn, last=True), df.schema), "mix-landing"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = _repeated(out.withColumn("extra", F.col("extra") + F.round("x").cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def taken(copies: Column, size: Column) -> Column:
    return (copies * size).cast("long")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return result(load(spark, sf_dir, "documents"))


def result(docs: DataFrame) -> DataFrame:
    df = mixed(docs)
    return df.select("doc_id", "size", "source_size", "target", taken(F.col("copies"), F.col("size")).alias("taken"))
