"""Near-duplicate documents by an inverted join on MinHash signatures.

A document's set holds the hashes of its distinct five-word shingles; its
signature has one minimum for each of ``K`` hash functions.  Copies share a
class, told by 128 bits of a cryptographic hash of their words, and classes are
joined:

1. Documents are written once in blocks (see ``blocks``), which post every
   (coordinate, value) of their classes' signatures with a count.  What a block
   hears back is how many classes have each value; those of one class alone are
   dropped.
2. Two classes with ``MATCH`` equal coordinates or more share one of the first
   ``K - MATCH + 1`` of either, from the rarest value: only this prefix is
   listed.  Lists with the same members are processed once.
3. In a list, collisions are counted over the whole signatures; members without
   a partner above the match threshold are skipped, the others split into what
   hangs together by collisions.
4. What hangs together over all lists is confirmed on the full sets, each sent
   once, where it fits a task (``LIST_ROWS``, ``LIST_SHINGLES``), and otherwise
   group by group of every list.  Pairs that links connect already are skipped, so
   a group of near copies emits fewer links than it has members.
5. Links make components; a component's id is its smallest document id.

A list longer than ``LIST_ROWS`` is dealt into parts, each treated on its own at
first.  What the links of all parts leave apart meets afterwards: the members
outside the list's largest component visit every other part.  So a long list of
near copies costs little more than its length, and no list is cut.

A pair at the similarity threshold is missed where fewer than MATCH of its K
coordinates collide: two in a million for 32 of 64 at 0.75, fewer above.

Edge cases: a null text counts as empty; without words the set is empty and
the document is linked with nothing; with fewer than five words the whole
sequence is the only shingle; a very long text is a block of its own, taken
whole; a null id never is a component's id unless no member has one; rows with
equal ids and texts share their result, and of different texts with one id each
has its own; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .blocks import BLOCK_BYTES, answered, block_ids, same
from .common import SALTS, bucketed, dropped, load, shards_of, spread_join, written
from .components import components

#: Coordinates of a signature, and how many must collide.
K, MATCH = 64, 32
#: Words of a shingle; similarity in hundredths that links.
SHINGLE, SIMILAR = 5, 75
#: Members of a list that a task takes at once, nearly: they are dealt by a hash.
LIST_ROWS = 4096
#: Sets that leave a block in one batch.
SENT_ROWS = 1000
#: Entries of the sets of what is confirmed at once.
LIST_SHINGLES = 8_000_000
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of each document (with repeats) and their offsets; word hashes and their offsets."""
    raw = tk.lowered(raw)
    starts, ends, word_off = tk.words(raw, off, tk.SPACED)
    hashes = tk.word_hashes(raw, starts, ends)
    runs = tk.windows(hashes, SHINGLE)
    ok = tk.valid(word_off, SHINGLE, len(runs))
    n = np.diff(word_off)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(out_off[-1], np.uint64)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    alone = np.zeros(len(out), bool)
    alone[out_off[short]] = True
    out[alone] = tk.sequences(hashes, word_off)[short]
    out[~alone] = runs[ok]
    return out, out_off, hashes, word_off


def signatures(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """K minima of every document that has shingles; the largest value elsewhere."""
    out = np.full((len(off) - 1, K), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        for j in range(K):
            out[full, j] = np.minimum.reduceat(((values * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32), off[full])
    return out


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents, in buckets of ``blk``.

    Lists with an entry a row: ``rows``, doc_id, and ``which``, its class in the
    block (-1 without words).  Lists with an entry a class: ``one`` and ``two``,
    its digest; ``id`` and ``at``, its least document and where that is; ``size``
    of its set.  ``sig`` has all signatures, as bytes.
    """
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    id_type, row_type = docs.schema[id_col].dataType, df.schema["row"].dataType
    lists = {"rows": row_type, "doc_id": id_type, "which": T.IntegerType(), "one": T.LongType(), "two": T.LongType(), "id": id_type, "at": T.IntegerType(), "size": T.IntegerType()}
    schema = T.StructType([T.StructField("blk", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, t in lists.items()], T.StructField("sig", T.BinaryType())])
    buckets = shards_of(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids(TaskContext.get().partitionId(), buckets)
        for b in batches:
            rows = b.column(0)
            ids, texts = rows.flatten()[at[0]], rows.flatten()[at[1]]
            for first, end, raw, off in tk.chunks(texts, BLOCK_BYTES):
                values, value_off, hashes, word_off = shingles(raw, off)
                own = ids.slice(first, end - first)
                digest = tk.digests(memoryview(hashes[i:j]) for i, j in zip(word_off[:-1].tolist(), word_off[1:].tolist(), strict=True))
                full = np.flatnonzero(np.diff(word_off))
                which = np.full(end - first, -1, np.int32)
                which[full] = same(digest[full, 0], digest[full, 1])
                rank = np.empty(len(own), np.int64)
                rank[pc.array_sort_indices(own, null_placement="at_end").to_numpy()] = np.arange(len(own))
                by = full[np.lexsort((rank[full], which[full]))]
                least = by[np.flatnonzero(np.diff(which[by], prepend=-1))]  # the class's least row
                parts = [values[value_off[k] : value_off[k + 1]] for k in least.tolist()]
                size = np.array([len(np.unique(v)) for v in parts], np.int32)
                sig = signatures(np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(v) for v in parts], dtype=np.int64)]))
                columns = [rows.slice(first, end - first), own, pa.array(which), *[pa.array(digest[least, k]) for k in (0, 1)], own.take(pa.array(least)), pa.array(least.astype(np.int32)), pa.array(size)]
                out = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *out, pa.array([sig.astype("<u4").tobytes()], pa.binary())], schema.names)

    return bucketed(df.mapInArrow(run, schema), "blk", "signed")


def _own(table: DataFrame) -> DataFrame:
    """blk, j (a class's place in the block), one, two and id."""
    return table.select("blk", F.posexplode(F.arrays_zip("one", "two", "id")).alias("j", "c")).select("blk", "j", "c.one", "c.two", "c.id")


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's batch and row, and of the classes that it speaks for the place, cls and signature."""
    for b in batches:
        for row in range(b.num_rows):
            reps = b.column("reps")[row].values
            if reps is not None and len(reps):
                j, cls = (x.to_numpy(zero_copy_only=False) for x in reps.flatten()[:2])
                yield b, row, j, cls, np.frombuffer(b.column("sig")[row].as_py(), "<u4").reshape(-1, K)[j]


def _keys(sig: np.ndarray) -> np.ndarray:
    """(coordinate, value) of every signature, as numbers."""
    return (np.arange(K, dtype=np.int64) << 32) | sig.astype(np.int64)


def _listed(spoken: DataFrame, match: int) -> DataFrame:
    """Postings of the prefixes: key and cls; and, without a key, sig (its low halves) and size of every class that has some."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, _, _, sig in _spoken(batches):
            key, n = np.unique(_keys(sig), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), b.column("blk")[row].as_py())), pa.array(n.astype(np.int32))], ["key", "blk", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, j, cls, sig in _spoken(batches):
            known = b.column("answers")[row].values
            if known is None or not len(known):
                continue
            value, n = (x.to_numpy(zero_copy_only=False) for x in known.flatten())
            by = np.argsort(value)
            value, n = value[by], n[by]
            keys = _keys(sig)
            k = np.minimum(np.searchsorted(value, keys), len(value) - 1)
            total = np.where(value[k] == keys, n[k], 1)
            # from the rarest; values of one class alone are the rarest and go unlisted
            order = np.lexsort((keys, total), axis=1)[:, : K - match + 1]
            keys, total = np.take_along_axis(keys, order, 1), np.take_along_axis(total, order, 1)
            shared = total > 1
            some = np.flatnonzero(shared.any(1))
            if not len(some):
                continue
            size = b.column("size")[row].values.to_numpy(zero_copy_only=False)[j]
            low = (sig & 0xFFFF).astype("<u2")
            pairs, none = int(shared.sum()), len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([keys[shared], np.zeros(none, np.int64)]), mask=np.arange(pairs + none) >= pairs),
                    pa.array(np.concatenate([np.repeat(cls, shared.sum(1)), cls[some]])),
                    pa.array([None] * pairs + [x.tobytes() for x in low[some]], pa.binary()),
                    pa.array(np.concatenate([np.zeros(pairs, np.int32), size[some]])),
                ],
                ["key", "cls", "sig", "size"],
            )

    posted = spoken.select("blk", "sig", "reps").mapInArrow(post, "key long, blk long, n int")
    shared = posted.withColumn("n", F.sum("n").over(Window.partitionBy("key"))).where("n > 1")
    asked = answered(spoken, shared.select("blk", F.struct("key", "n").alias("answer")))
    return written(asked.mapInArrow(cut, "key long, cls long, sig binary, size int"), "listed")


def _summed(rows: DataFrame, keys: list[str], *members: str) -> DataFrame:
    """Per group, its size n and two sums that tell its members."""
    h = F.xxhash64(*members)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 34)).alias("s"), F.bit_xor(h).alias("x"))


def _lists(listed: DataFrame) -> DataFrame:
    """key, cls and n, the members of the list; lists of two or more, no two with the same members."""
    salted = listed.where(F.col("key").isNotNull()).select("key", "cls").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    whole = _summed(salted, ["key", "salt"], "cls").groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.collect_list("salt").alias("seats"))
    once = whole.where("n > 1").groupBy("n", "s", "x").agg(F.min("key").alias("key"), F.min_by("seats", "key").alias("seats"))
    return written(salted.join(once.select("key", "n", F.explode("seats").alias("salt")), ["key", "salt"]).select("key", "cls", "n"), "lists")


def _similar_sizes(size: np.ndarray, i: int, other: np.ndarray, similar: int) -> np.ndarray:
    """Those of ``other`` whose sets are not too unlike in size to be similar to i's."""
    low, high = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
    return other[100 * low >= similar * high]


def _meeting(i: int, grp: np.ndarray, side: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Members after i that may still be linked with it: on the other side, or on no side, and in no group with it."""
    rest = slice(i + 1, None)
    ok = (group[rest] != group[i]) & (grp[rest] != grp[i])
    if side[i] >= 0:
        ok &= side[rest] != side[i]
    return np.flatnonzero(ok) + i + 1


def sifted(sig: np.ndarray, size: np.ndarray, grp: np.ndarray, side: np.ndarray, match: int = MATCH, similar: int = SIMILAR) -> np.ndarray:
    """The number of each member's group, in which members hang together by collisions above the threshold; -1 without a partner."""
    group = np.arange(len(size))
    found = np.zeros(len(size), bool)
    for i in range(len(size) - 1):
        other = _similar_sizes(size, i, _meeting(i, grp, side, group), similar)
        hit = other[(sig[other] == sig[i]).sum(1) >= match] if len(other) else other
        if len(hit):
            found[i] = found[hit] = True
            group[np.isin(group, group[hit])] = group[i]
    return np.where(found, group, -1)


def _numbered(sets: list[np.ndarray], off: np.ndarray) -> tuple[np.ndarray, int]:
    """The members of all sets as numbers, in a row, and how many numbers there are; takes little more memory than the sets twice."""
    distinct = np.concatenate(sets)
    distinct.sort()
    head = np.ones(len(distinct), bool)
    np.not_equal(distinct[1:], distinct[:-1], out=head[1:])
    distinct = distinct[head]
    out = np.empty(off[-1], np.int64)
    for s, i, j in zip(sets, off[:-1], off[1:], strict=True):
        out[i:j] = np.searchsorted(distinct, s)
    return out, len(distinct)


def links_of(sig: np.ndarray, sets: list[np.ndarray], grp: np.ndarray | None = None, side: np.ndarray | None = None, match: int = MATCH, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """Links that connect what is linked among some members, from the first of what hangs together to each other.

    Members of one ``grp`` are connected already; with a ``side`` of 0 or 1, only
    pairs across sides count.
    """
    m = len(sets)
    grp = np.arange(m) if grp is None else grp
    side = np.full(m, -1) if side is None else side
    size = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(size)])
    if m > 2:
        words, n = _numbered(sets, off)
        mark = np.zeros(n, bool)
    group = np.arange(m)
    for i in range(m - 1):
        other = _similar_sizes(size, i, _meeting(i, grp, side, group), similar)
        other = other[(sig[other] == sig[i]).sum(1) >= match]
        if not len(other):
            continue
        if m == 2:
            common = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
        else:
            own = words[off[i] : off[i + 1]]
            mark[own] = True
            if 4 * len(other) > m:
                common = np.add.reduceat(mark[words], off[:-1], dtype=np.int64)[other]
            else:
                common = np.array([np.count_nonzero(mark[words[off[j] : off[j + 1]]]) for j in other])
            mark[own] = False
        hit = other[100 * common >= similar * (size[i] + size[other] - common)]
        if len(hit):
            group[np.isin(group, group[hit])] = group[i]
    lead = np.flatnonzero(np.bincount(group, minlength=m) > 1)
    first = np.full(m, -1)
    first[group[::-1]] = np.arange(m)[::-1]
    return [(int(first[g]), int(k)) for g in lead for k in np.flatnonzero(group == g) if k != first[g]]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first ``n_keys`` columns, whole numbers, from sorted batches."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        out = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()  # before the group is worked on
        return out

    def key(b: pa.RecordBatch, row: int) -> list:
        return [b.column(k)[row].as_py() for k in range(n_keys)]

    for b in batches:
        if not b.num_rows:
            continue
        turn = np.zeros(b.num_rows, bool)
        for k in range(n_keys):
            v = b.column(k).to_numpy(zero_copy_only=False)
            turn[1:] |= v[1:] != v[:-1]
        if held and key(held[-1], 0) != key(b, 0):
            yield whole()
        cut = [0, *np.flatnonzero(turn).tolist(), b.num_rows]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield whole()
    if held:
        yield whole()


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False)


#: What tells the parts of lists apart, and the groups in them.
_PLACE = ["key", "p", "q"]
_WHERE = [*_PLACE, "g"]


def _sets(table: DataFrame, classes: DataFrame, places: DataFrame, text_col: str) -> DataFrame:
    """``places`` (key, p, q, g, side, grp, cls) with sig (its low halves) and set (its sorted distinct shingle hashes) of each class."""
    names = [*_WHERE, "side", "grp", "cls"]
    needed = places.join(classes.select("cls", "blk", "j"), "cls").select("blk", F.struct("j", "cls", *names[:-1]).alias("answer"))
    blocks = table.select("blk", F.col(f"rows.`{text_col}`").alias("texts"), "at", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, j, cls, sig in _spoken(batches):
            distinct, of = np.unique(j, return_inverse=True)
            at = b.column("at")[row].values.take(pa.array(distinct))
            sets = []
            for _, _, raw, off in tk.chunks(b.column("texts")[row].values.take(at)):
                values, value_off, _, _ = shingles(raw, off)
                sets += [np.unique(values[i:k]).astype("<u8").tobytes() for i, k in zip(value_off[:-1], value_off[1:], strict=True)]
            low = (sig & 0xFFFF).astype("<u2")
            place = b.column("reps")[row].values.flatten()[2:]
            for i in range(0, len(j), SENT_ROWS):
                part = slice(i, i + SENT_ROWS)
                yield pa.RecordBatch.from_arrays([*[x[part] for x in place], pa.array(cls[part]), pa.array([x.tobytes() for x in low[part]], pa.binary()), pa.array([sets[k] for k in of[part]], pa.binary())], [*names, "sig", "set"])

    return answered(blocks, needed, "reps").mapInArrow(run, "key long, p int, q int, g int, side int, grp long, cls long, sig binary, set binary")


def _sifted(members: DataFrame, signatures_: DataFrame, match: int, similar: int) -> DataFrame:
    """The ``members`` (key, p, q, side, grp, cls) of the parts of lists that have a partner, with g, their group, and lead, its first member."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 3):
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, K)
            group = sifted(sig, _numbers(b, "size").astype(np.int64), _numbers(b, "grp"), _numbers(b, "side"), match, similar)
            keep = group >= 0
            if keep.any():
                out = b.select([*_PLACE, "side", "grp", "cls"]).filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(group[keep].astype(np.int32)), pa.array(_numbers(b, "cls")[group[keep]])], [*out.schema.names, "g", "lead"])

    rows = members.join(signatures_, "cls").select(*_PLACE, "side", "grp", "cls", "size", "sig")
    rows = rows.repartition(shards_of(members), *_PLACE).sortWithinPartitions(*_PLACE, "cls", "side")
    return written(rows.mapInArrow(sift, "key long, p int, q int, side int, grp long, cls long, g int, lead long"), "passed")


def _whole(passed: DataFrame, signatures_: DataFrame) -> DataFrame:
    """``whole`` (what a class hangs together with over all lists) of every class, and whether that is ``small`` enough for one task."""
    roots = components(passed.select(F.col("lead").alias("a"), F.col("cls").alias("b")), "hanging")
    every = passed.select("cls").distinct().join(roots, F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("root", "cls").alias("whole"))
    per = every.join(signatures_, "cls").groupBy("whole").agg(((F.count("*") <= LIST_ROWS) & (F.sum("size") <= LIST_SHINGLES)).alias("small"))
    return written(spread_join(every, per, ["whole"], "cls"), "wholes")


def _confirmed(b: pa.RecordBatch, match: int, similar: int) -> pa.RecordBatch:
    """Links (a, b) of a group's classes; the sets are read where they lie in the batch."""
    sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, K)
    sets = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column("set")]
    pairs = np.array(links_of(sig, sets, _numbers(b, "grp"), _numbers(b, "side"), match, similar) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
    cls = _numbers(b, "cls")
    return pa.RecordBatch.from_arrays([pa.array(cls[pairs[:, k]]) for k in (0, 1)], ["a", "b"])


def _linked(passed: DataFrame, wholes: DataFrame | None, table: DataFrame, classes: DataFrame, match: int, similar: int, text_col: str) -> DataFrame:
    """Links (a, b) of classes that the full sets confirm.

    What hangs together over all lists and is small is confirmed at once, each
    set sent once; of the rest, and without ``wholes``, group by group.
    """
    rows = passed if wholes is None else passed.join(wholes.where(~F.col("small")).select("cls"), "cls", "left_semi")
    # groups with the same members are confirmed once
    once = _summed(rows, _WHERE, "cls", "side").groupBy("n", "s", "x").agg(F.min(F.struct(*_WHERE)).alias("of")).select("of.*")
    rows = rows.join(once, _WHERE).select(*_WHERE, "side", "grp", "cls")
    if wholes is not None:
        small = wholes.where("small").select(F.col("whole").alias("key"), F.lit(-1).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("g"), F.lit(-1).alias("side"), F.col("cls").alias("grp"), "cls")
        rows = rows.unionByName(small)
    full = _sets(table, classes, rows, text_col)
    full = full.repartition(shards_of(table), *_WHERE).sortWithinPartitions(*_WHERE, "cls", "side")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _groups(batches, 4):
            links = _confirmed(b, match, similar)
            del b  # a group may be large, and the next one is gathered
            if links.num_rows:
                yield links

    return written(full.mapInArrow(confirm, "a long, b long"), "links")


def grouped(table: DataFrame, match: int = MATCH, similar: int = SIMILAR, text_col: str = "text") -> DataFrame:
    """blk, j and component_id of every class of every block of a ``signed`` table."""
    own = _own(table)
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "blk", "j")).alias("least")
    classes = own.groupBy("one", "two").agg(least).select(F.monotonically_increasing_id().alias("cls"), "one", "two", "least.id", "least.blk", "least.j")
    classes = written(classes, "classes")
    spoken = answered(table.select("blk", "sig", "size"), classes.select("blk", F.struct("j", "cls").alias("answer")), "reps")
    listed = _listed(spoken, match)
    sigs = listed.where(F.col("key").isNull()).select("cls", "sig", "size")
    lists = _lists(listed)
    parts = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    part = F.pmod(F.xxhash64("key", "cls"), parts).cast("int").alias("p")
    alone = lists.select("key", part, F.lit(0).alias("q"), F.lit(-1).alias("side"), F.col("cls").alias("grp"), "cls")
    passed = _sifted(alone, sigs, match, similar)
    wholes = _whole(passed, sigs)
    links = _linked(passed, wholes, table, classes, match, similar, text_col)
    dropped(passed, wholes)
    roots = components(links)
    long = lists.where(F.col("n") > LIST_ROWS)
    if not long.isEmpty():
        met = _sifted(_visits(long, roots, part, parts), sigs, match, similar)
        links = links.unionByName(_linked(met, None, table, classes, match, similar, text_col))
        roots = components(links)
    member = classes.join(roots, F.col("cls") == F.col("v"), "left").select("cls", "one", "two", "id", F.coalesce("root", "cls").alias("root"))
    ids = member.groupBy("root").agg(F.min("id").alias("component_id"))
    found = spread_join(member, ids, ["root"], "cls").select("one", "two", "component_id")
    out = written(spread_join(own.select("blk", "j", "one", "two"), found, ["one", "two"], "blk").select("blk", "j", "component_id"), "grouped")
    dropped(listed, lists)
    return out


def _visits(lists: DataFrame, roots: DataFrame, part, parts) -> DataFrame:
    """Members of long lists that are not yet one component: all at home, and those outside the largest one as visitors of every part."""
    now = lists.join(roots, F.col("cls") == F.col("v"), "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("grp"))
    per = now.groupBy("key", "grp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("grp", "c").alias("major"), (F.sum("c") - F.max("c")).alias("minor"))
    now = spread_join(now, per.where("minor > 0"), ["key"], "cls")
    turns = F.ceil(F.col("minor") / LIST_ROWS).cast("int")
    home = now.select("key", part, F.explode(F.sequence(F.lit(0), turns - 1)).alias("q"), F.lit(0).alias("side"), "grp", "cls")
    visit = now.where("grp != major").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("p"), F.pmod(F.xxhash64("cls"), turns).cast("int").alias("q"), F.lit(1).alias("side"), "grp", "cls")
    return written(home.unionByName(visit), "visits")


def _answers(table: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    return answered(table.select("blk", "which", "doc_id", *columns), found.select("blk", F.struct("j", "component_id").alias("answer")))


def _of_rows(b: pa.RecordBatch, row: int) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """doc_id, component_id and kept of every row of a block, and its class's place (-1 without words)."""
    ids, which = b.column("doc_id")[row].values, b.column("which")[row].values.to_numpy(zero_copy_only=False)
    found = b.column("answers")[row].values
    component = ids
    if found is not None and len(found):
        j, of = found.flatten()
        by = np.argsort(j.to_numpy(zero_copy_only=False))
        component = of.take(pa.array(by)).take(pa.array(which, mask=which < 0))
        component = pc.if_else(pa.array(which < 0), ids, component)
    kept = pc.or_kleene(pc.fill_null(pc.equal(ids, component), False), pc.and_(pc.is_null(ids), pc.is_null(component)))
    return ids, component, kept, which


def clustered(docs: DataFrame, match: int = MATCH, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    table = signed(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    found = grouped(table, match, similar)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                ids, component, kept, which = _of_rows(b, row)
                size = np.append(b.column("size")[row].values.to_numpy(zero_copy_only=False), 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size[which]), component, kept], ["doc_id", "n_shingles", "component_id", "kept"])

    return _answers(table, ["size"], found).mapInArrow(run, f"doc_id {id_type}, n_shingles long, component_id {id_type}, kept boolean")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, one document of each group; rows of equal id and text stay together."""
    table = signed(docs, id_col, text_col)
    found, names = grouped(table, text_col=text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                _, _, kept, which = _of_rows(b, row)
                rows = b.column("rows")[row].values.filter(pc.or_(kept, pa.array(which < 0)))
                yield pa.RecordBatch.from_arrays(rows.flatten(), names)

    return _answers(table, ["rows"], found).mapInArrow(run, docs.schema)


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    """The group of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return clustered(docs).select("doc_id", "n_shingles", "component_id", "kept")
