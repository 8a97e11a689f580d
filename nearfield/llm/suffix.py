"""Suffix-array dedup: bytes covered by a string of 100 bytes that starts earlier somewhere else.

1. Texts that are copies of earlier ones go as a whole.  Of the others, every 100
   bytes hold an anchor: the 32-byte gram of the smallest rank in them, 32 bits
   of a cheap hash.  Equal strings have equal anchors, and of the 68 other bytes
   34 or more stand on one side.  So a repeated string lies around an anchor that
   is repeated with the 34 bytes before it or those after it; a count-min
   prefilter over both (see ``blocks``) leaves those.
2. The surroundings of an anchor are the bytes of all strings that chose it, 168
   at most.  Their hash goes to the shard of the anchor, equal ones once a
   block.  All surroundings but the first equal ones are repeated as a whole;
   the first ones are asked for where others have the same anchor.
3. The shard of an anchor sorts the suffixes of what it asked for and expands
   intervals of their Burrows-Wheeler transform: breadth first, each string of
   l bytes is extended backward by every byte before it, a run of equal bytes of
   the transform at a time, and the ends of the intervals that come up first for
   l + 1 bytes are the places where neighbours share just l bytes.  The expansion
   stops at 100: neighbours without such a place share 100 bytes, and of those
   all but the first are repeated.
4. What is repeated is removed.

An anchor that many blocks have goes another way, which splits it: its strings
are told apart by two hashes of 48 bits each, dealt over all shards, each block
sending a string once.

Places are ordered by document id, then start; null ids count as the largest.
Equal starts in rows of equal ids are one place: neither removes the other's
bytes.

Edge cases: a null text counts as empty; a text of less than 100 bytes loses
nothing; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .blocks import Opened, answered, by_group, first_of, maybe_repeated, opened, packed, prefiltered, same, sent_hash, shard_of, spread, squeezed, two_hashes, with_copies
from .common import load, shards_of, written

#: Bytes of a string that is removed, and of an anchor's gram.
LEAST, GRAM = 100, 32
#: Blocks from which on an anchor's strings are dealt one by one; counters end at 255.
HOT_BLOCKS = 250
#: Bytes whose suffixes are sorted at once, unless one anchor has more: few, so that they stay in a processor's cache.
SORT_BYTES = 1 << 17
#: Places whose grams are ranked at once, for the same reason.
RANKED = 1 << 15
#: Bytes that no UTF-8 text has: between strings, and after the last.
_BETWEEN, _AFTER = 0xFF, 0xFE
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number whose order is theirs; the text goes on as _AFTER."""
    n = len(raw)
    padded = np.full(n + 16, _AFTER, np.uint8)
    padded[:n] = raw
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + (n + 15 - r) // 8 * 8].view(">u8")
        at = out[r::8]
        at[:] = part[: len(at)]
    return out[:n]


def _loose(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, where there are eight; looked up, not copied."""
    return np.ndarray(max(len(raw) - 7, 0), "<u8", np.ascontiguousarray(raw), strides=(1,))


def _slid(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``width`` neighbours."""
    have, out = 1, a
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    return best(out[: len(a) - width + 1], out[width - have : width - have + len(a) - width + 1])


def _ranks(eights: np.ndarray, gram: int) -> np.ndarray:
    """A number above 0 for the gram at each place, of its bytes alone; grams of one rank need not be equal."""
    x = np.zeros(len(eights) - gram + 1, np.uint64)
    for k in range(gram // 8):
        x += eights[8 * k : 8 * k + len(x)] * _M[k % len(_M)]
    x ^= x >> np.uint64(32)
    x *= _M[0]
    x >>= np.uint64(32)
    return x.astype(np.uint32) | np.uint32(1)


def _hashed(eights: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of places in ``eights``, of the bytes there."""
    h = np.zeros(len(at[0]), np.uint64)
    for k, i in enumerate(at):
        h += tk.mixed(eights[i] ^ _M[k // len(_M)]) * _M[k % len(_M)]
    return tk.mixed(h) | np.uint64(1)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` of them."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def anchors(raw: np.ndarray, off: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, from, to) of the anchors, grams of the smallest rank in some ``least`` bytes of one document.

    The strings that chose an anchor start at ``from`` to ``to``; a string in
    which the smallest rank comes up twice chooses both.
    """
    n, span = len(raw), least - gram + 1
    if n < least:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    rank, low = np.empty(n - gram + 1, np.uint32), np.empty(n - least + 1, np.uint32)
    for i in range(0, len(low), RANKED):
        part = _ranks(_eights(raw[i : i + RANKED + least - 1]), gram)
        rank[i : i + len(part)] = part
        low[i : i + RANKED] = _slid(part, span, np.minimum)
    # strings that cross documents choose no anchor
    ends = np.minimum(off[1:], len(low))
    begins = np.minimum(np.maximum(off[:-1], off[1:] - least + 1), ends)
    low[_ranges(begins, ends - begins)] = 0
    none, found = np.zeros(span - 1, np.uint32), []
    for i in range(0, len(rank), RANKED):
        # the starts of the strings that hold a gram are the span before it
        near = low[max(i - span + 1, 0) : i + RANKED]
        near = np.concatenate([none[: max(span - 1 - i, 0)], near, none[: max(min(i + RANKED, len(rank)) - len(low), 0)]])
        best = _slid(near, span, np.maximum)
        found.append(np.flatnonzero(best == rank[i : i + RANKED]) + i)
    place = np.concatenate(found)
    # the run of starts that chose an anchor is one of the few among the span before it
    begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    stop = np.append(begin[1:], len(low)) - 1
    run = np.searchsorted(stop, place - span + 1)
    while True:
        wrong = np.flatnonzero(low[begin[run]] != rank[place])
        if not len(wrong):
            break
        run[wrong] += 1
    return place, np.maximum(begin[run], place - span + 1), np.minimum(stop[run], place)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` bytes from each on, by the ranks of fewer, two or more at a time; the text goes on as _AFTER."""
    n, key, have = len(text), _eights(text), 8
    bits = np.uint64(n.bit_length())
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        key, step = rank.copy(), have
        for _ in range(64 // int(bits) - 1):  # as many ranks as a number holds
            if have >= depth:
                break
            at = min(have, depth - step)
            key <<= bits
            key[:-at] |= rank[at:]
            key[-at:] |= rank[-1]
            have = at + step


def apart(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Where neighbours in ``order`` share fewer than ``least`` bytes, by backward extension on the transform.

    ``text`` ends with one _AFTER.  Entry i is about rows i - 1 and i.
    """
    n = len(text)
    before = text[order - 1]  # the Burrows-Wheeler transform; the first place wraps to the end
    by_byte = np.argsort(before, kind="stable")
    to = np.empty(n, np.int32)  # the row of a row's string with its byte before
    to[by_byte] = np.arange(n, dtype=np.int32)
    first = before[by_byte]
    turn = np.concatenate([[False], first[1:] != first[:-1]])
    # rows of one run keep together
    runs = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])).astype(np.int32)
    ends = np.append(runs[1:], np.int32(n))
    run_of = np.repeat(np.arange(len(runs), dtype=np.int32), ends - runs)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    seat, wide = np.empty(n, np.int32), np.empty(n, np.int32)
    for _ in range(least):  # the intervals are those of strings of this many bytes
        if not len(low):
            break
        run = run_of[low]
        count = run_of[high - 1] - run + 1
        stop = np.cumsum(count, dtype=np.int32)
        own = np.repeat(np.arange(len(low), dtype=np.int32), count)
        every = np.arange(len(own), dtype=np.int32) + np.repeat(run - (stop - count), count)
        row, end = runs[every], ends[every]
        row[stop - count], end[stop - 1] = low, high  # the first and the last may begin or go on outside
        t, size = to[row], end - row
        if 8 * len(t) > n:  # many runs are put in order faster by their seats
            seat.fill(-1)
            seat[t], wide[t] = own, size
            t = np.flatnonzero(seat >= 0).astype(np.int32)
            own, size = seat[t], wide[t]
        else:
            by = np.argsort(t)
            t, own, size = t[by], own[by], size[by]
        end = t + size
        head = np.ones(len(t), bool)
        head[1:] = (t[1:] != end[:-1]) | (own[1:] != own[:-1]) | turn[t[1:]]
        at = np.flatnonzero(head)
        begin, end = t[at], end[np.append(at[1:], len(t)) - 1]
        new = ~found[end]
        found[end[new]] = True
        low, high = begin[new], end[new]
    return found[:n]


def repeats(parts: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, offset, class) of the strings of ``least`` bytes that the parts have twice or more."""
    size = np.array([len(p) for p in parts])
    text = np.full(int(size.sum()) + len(parts), _BETWEEN, np.uint8)
    at = np.cumsum(size + 1) - size - 1
    for p, i in zip(parts, at, strict=True):
        text[i : i + len(p)] = p
    text[-1] = _AFTER
    order = suffix_order(text, least)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(apart(text, order, least))
    count = np.maximum(size - least + 1, 0)
    part = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    cls = group[at[part] + offset]
    twice = (np.bincount(cls) > 1)[cls] if len(cls) else np.zeros(0, bool)
    return part[twice], offset[twice], cls[twice]


#: Columns of what is sent: their numbers, and whether those rise.
_TYPES = {"place": ("<u4", True), "size": ("u1", False), "hash": ("<u8", False), "second": ("<u8", False), "order": ("<i8", True), "start": ("<i8", True)}
_COLUMNS = [("kind", pa.int32()), ("shard", pa.int32()), ("blk", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in _TYPES], ("bytes", pa.binary())]
_SCHEMA = "kind int, shard int, blk long, n int, " + ", ".join(f"{c} binary" for c in [*_TYPES, "bytes"])
#: Kinds of rows: surroundings by hash; what the block itself has earlier; strings of hot anchors by hash; surroundings asked for.
_HASHED, _OWN, _HOT, _WHOLE = range(4)


def _batch(rows: list[tuple[int, int, int, dict[str, np.ndarray], bytes | None]]) -> pa.RecordBatch:
    """Rows (kind, shard, blk, columns, bytes)."""
    values = [
        [r[0] for r in rows],
        [r[1] for r in rows],
        [r[2] for r in rows],
        [len(r[3]["place"]) for r in rows],
        *[[squeezed(r[3][c].astype(t), rising) if c in r[3] else None for r in rows] for c, (t, rising) in _TYPES.items()],
        [r[4] for r in rows],
    ]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, _COLUMNS, strict=True)], [c for c, _ in _COLUMNS])


def _read(rows: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of such rows of one kind, and each entry's block."""
    held = {c: np.concatenate([spread(r[c], r["n"], *t) for r in rows]) for c, t in _TYPES.items() if rows[0][c] is not None}
    return held, np.repeat([r["blk"] for r in rows], [r["n"] for r in rows])


def _by_block(kind: int, blk: np.ndarray, columns: dict[str, np.ndarray]) -> list[tuple]:
    """A row for each block, its entries in the order of their places."""
    if not len(blk):
        return []
    by = np.lexsort((columns["place"], blk))
    blk, columns = blk[by], {c: v[by] for c, v in columns.items()}
    heads = np.flatnonzero(np.concatenate([[True], blk[1:] != blk[:-1]]))
    return [(kind, -1, int(blk[i]), {c: v[i:j] for c, v in columns.items()}, None) for i, j in zip(heads, [*heads[1:], len(blk)], strict=True)]


def _sides(block: Opened) -> tuple[np.ndarray, ...]:
    """Place, hash, from, to and document of the anchors of texts that are no copies, and the hashes of each with half of the other bytes before and after it, 0 where those end."""
    raw, off = block.raw, block.off
    place, low, high = anchors(raw, off)
    doc = np.searchsorted(off, place, side="right") - 1
    own = ~block.copy[doc]
    place, low, high, doc = place[own], low[own], high[own], doc[own]
    eights = _loose(raw)
    h = _hashed(eights, [place + k for k in range(0, GRAM, 8)])
    half = (LEAST - GRAM) // 2
    sides = []
    for ok, at in ((place - half >= off[doc], place - half), (place + GRAM + half <= off[doc + 1], place + GRAM)):
        out = np.zeros(len(place), np.uint64)
        steps = [*range(0, half - 8, 8), half - 8]
        # the side and the gram; a prefilter may take different ones for the same
        out[ok] = tk.mixed(_hashed(eights, [at[ok] + k for k in steps]) + h[ok] * _M[1 + len(sides)]) | np.uint64(1)
        sides.append(out)
    return place, h, low, high, doc, *sides


def _asked(block: Opened) -> np.ndarray:
    """What the prefilter counts: both sides of each anchor, and the anchors, for their heat."""
    _, h, _, _, _, before, after = _sides(block)
    return np.concatenate([before[before > 0], after[after > 0], h])


def _around(block: Opened, answers: list[dict], shards: int) -> tuple[np.ndarray, ...]:
    """Hash, document, begin, end and heat of the surroundings that may hold a repeated string."""
    place, h, low, high, doc, before, after = _sides(block)
    held, hot = maybe_repeated(np.concatenate([before[before > 0], after[after > 0], h]), answers, shards)
    n, m = np.count_nonzero(before), np.count_nonzero(after)
    maybe = np.zeros((2, len(place)), bool)
    maybe[0, before > 0] = held[:n]
    maybe[1, after > 0] = held[n : n + m]
    half = (LEAST - GRAM) // 2
    # strings with half of the bytes on a side that isn't repeated are out
    low = np.where(maybe[0], low, np.maximum(low, place - half + 1))
    high = np.where(maybe[1], high, np.minimum(high, place - half - 1))
    ok = maybe.any(0) & (low <= high)
    return h[ok], doc[ok], low[ok], high[ok] + LEAST, hot[n + m :][ok]


def _sent(blocks: DataFrame, shards: int) -> DataFrame:
    """What each block sends to the shards, and what it has itself earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in opened(batches):
            h, doc, begin, end, hot = _around(block, answers, shards)
            out = []
            for kind, of in ((_HASHED, ~hot), (_HOT, hot)):
                if not of.any():
                    continue
                if kind == _HASHED:
                    at, stop, own, one = begin[of], end[of], doc[of], sent_hash(h[of])
                    # the anchor's hash, and one of all its surroundings
                    two = sent_hash(tk.word_hashes(block.raw, at, stop))
                else:
                    n = end[of] - begin[of] - LEAST + 1
                    at = np.unique(np.repeat(begin[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    stop, own = at + LEAST, np.searchsorted(block.off, at, side="right") - 1
                    one, two = map(sent_hash, two_hashes(block.raw, at, stop))
                columns = {"place": at, "size": stop - at, "hash": one, "second": two, "order": block.order[own], "start": at - block.off[own]}
                first = first_of(columns["order"], columns["start"], same(one, two))
                if not first.all():
                    out.append((_OWN, -1, block.blk, {c: columns[c][~first] for c in ("place", "size")}, None))
                shard = np.where(first, shard_of(one, shards), -1)
                by = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[by], np.arange(shards + 1))
                out += [(kind, s, block.blk, {c: v[by[i:j]] for c, v in columns.items()}, None) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            if out:
                yield _batch(out)

    return blocks.mapInArrow(run, _SCHEMA)


def _compared(sent: DataFrame, shards: int) -> DataFrame:
    """For each block: what other blocks have earlier (_OWN), and surroundings that the anchor's shard asks for (_WHOLE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, every in by_group(batches, "shard"):
            out = []
            for kind in (_HASHED, _HOT):
                rows = [r for r in every if r["kind"] == kind]
                if not rows:
                    continue
                of, blk = _read(rows)
                group = same(of["hash"], of["second"])
                first = first_of(of["order"], of["start"], group)
                out += _by_block(_OWN, blk[~first], {c: of[c][~first] for c in ("place", "size")})
                if kind == _HASHED:
                    # an anchor with surroundings of one kind only has nothing more to compare
                    anchor = np.unique(of["hash"], return_inverse=True)[1]
                    kinds = np.bincount(anchor[np.unique(group, return_index=True)[1]], minlength=anchor.max() + 1)
                    ask = first & (kinds[anchor] > 1)
                    out += _by_block(_WHOLE, blk[ask], {c: of[c][ask] for c in ("place", "size", "hash")})
            if out:
                yield _batch(out)

    kinds = F.col("kind").isin(_HASHED, _HOT)
    return sent.where(kinds).repartition(shards, "shard").sortWithinPartitions("shard", "blk").mapInArrow(run, _SCHEMA)


def _whole(blocks: DataFrame, shards: int) -> DataFrame:
    """The surroundings that were asked for, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in opened(batches):
            if not answers:
                continue
            of = {c: np.concatenate([spread(a[c], a["n"], *_TYPES[c]) for a in answers]) for c in ("place", "size", "hash")}
            at = of["place"].astype(np.int64)
            doc = np.searchsorted(block.off, at, side="right") - 1
            of |= {"order": block.order[doc], "start": at - block.off[doc]}
            data = block.raw.tobytes()
            shard = shard_of(of["hash"], shards)
            by = np.lexsort((at, shard))
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            out = []
            for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if j > i:
                    rows = by[i:j]
                    strings = b"".join([data[a : a + n] for a, n in zip(at[rows].tolist(), of["size"][rows].tolist(), strict=True)])
                    out.append((_WHOLE, s, block.blk, {c: v[rows] for c, v in of.items()}, pa.compress(strings, codec="zstd", asbytes=True)))
            yield _batch(out)

    return blocks.mapInArrow(run, _SCHEMA)


def _covered(part: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, begin, size) of the runs that strings at these offsets cover, merged."""
    order = np.lexsort((offset, part))
    part, offset = part[order], offset[order]
    head = np.concatenate([[True], (part[1:] != part[:-1]) | (offset[1:] > offset[:-1] + LEAST)])
    last = np.concatenate([head[1:], [True]])
    return part[head], offset[head], offset[last] + LEAST - offset[head]


def _expanded(sent: DataFrame, shards: int) -> DataFrame:
    """What starts earlier in other surroundings of the same anchor, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches, "shard"):
            of, blk = _read(rows)
            size = of["size"].astype(np.int64)
            data = np.concatenate([np.frombuffer(pa.decompress(r["bytes"], decompressed_size=int(spread(r["size"], r["n"], "u1", False).sum(dtype=np.int64)), codec="zstd"), np.uint8) for r in rows])
            at = np.cumsum(size) - size
            by = np.argsort(of["hash"], kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], of["hash"][by][1:] != of["hash"][by][:-1]]))
            # whole anchors, as many as fit a sort
            room = np.cumsum(size[by])[np.append(heads[1:], len(by)) - 1] // SORT_BYTES
            starts = heads[np.concatenate([[True], room[1:] != room[:-1]])]
            for i, j in zip(starts, [*starts[1:], len(by)], strict=True):
                own = by[i:j]
                part, offset, cls = repeats([data[at[r] : at[r] + size[r]] for r in own])
                if not len(part):
                    continue
                row = own[part]
                later = ~first_of(of["order"][row], of["start"][row] + offset, cls)
                if later.any():
                    part, begin, long = _covered(part[later], offset[later])
                    yield _batch(_by_block(_OWN, blk[own[part]], {"place": of["place"][own[part]] + begin, "size": long}))

    return sent.repartition(shards, "shard").sortWithinPartitions("shard", "blk").mapInArrow(run, _SCHEMA)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_BLOCKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes left."""
    blocks = with_copies(packed(docs, id_col, text_col))
    shards = shards_of(blocks)
    maybe = prefiltered(blocks, _asked, shards, hot)
    sent = written(_sent(answered(blocks, maybe), shards), "surroundings")
    compared = written(_compared(sent, shards), "compared")
    asked = compared.where(F.col("kind") == _WHOLE).select("blk", F.struct("n", "place", "size", "hash").alias("answer"))
    found = written(_expanded(_whole(answered(blocks, asked), shards), shards), "repeated")
    gone = sent.unionByName(compared).unionByName(found).where(F.col("kind") == _OWN).select("blk", F.struct("n", "place", "size").alias("answer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in opened(batches):
            change = np.zeros(len(block.raw) + 1, np.int32)
            for a in answers:
                place = spread(a["place"], a["n"], "<u4").astype(np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + spread(a["size"], a["n"], "u1", False).astype(np.int64), -1)
            out = (np.cumsum(change[:-1]) > 0) | np.repeat(block.copy & (np.diff(block.off) >= LEAST), np.diff(block.off))
            begins = out.copy()
            begins[1:] &= ~out[:-1]
            inner = block.off[:-1][np.diff(block.off) > 0]
            begins[inner] = out[inner]  # runs end with their document
            total, runs = (np.concatenate([[0], np.cumsum(x)]) for x in (out, begins))
            n_removed = total[block.off[1:]] - total[block.off[:-1]]
            n_spans = runs[block.off[1:]] - runs[block.off[:-1]]
            kept_off = block.off - total[block.off]
            data = block.raw[~out].tobytes()
            kept = [data[i:j] for i, j in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(np.diff(block.off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return answered(blocks, gone).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that start earlier."""
    return removed(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
