"""Substring dedup: words covered by a window of words that starts earlier somewhere else.

1. Texts that are copies of earlier ones go as a whole; of the others, a
   count-min prefilter (see ``blocks``) leaves the windows that may be
   repeated; it overestimates, and loses none.
2. A second pass groups exactly those by two hashes of 48 bits each.  A block first
   settles repeats of its own, so that it sends a window at most once, however
   common that is; the shard of a window then knows its first place and
   answers every block in which it starts later.
3. Words under a window that starts earlier elsewhere go.

Places are ordered by document id, then start; null ids count as the largest.
Equal starts in rows of equal ids are one place: neither removes the other's
words.

Edge cases: a null or empty text has no words, as has one of white space; a
text shorter than a window loses nothing; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .blocks import Opened, answered, by_group, first_of, maybe_repeated, opened, packed, prefiltered, same, sent_hash, shard_of, spread, squeezed, with_copies
from .common import load, shards_of, written

#: Words of a window.
WIDTH = 20


def _windows(block: Opened, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word) of every window of the block's texts that are no copies, and the word offsets."""
    starts, ends, word_off = tk.words(block.raw, block.off, tk.SPACED)
    runs = tk.windows(tk.word_hashes(block.raw, starts, ends), width)
    own = ~np.repeat(block.copy, np.diff(word_off))[: len(runs)]
    at = np.flatnonzero(tk.valid(word_off, width, len(runs)) & own)
    return runs[at], at, word_off


def _second(block: Opened, at: np.ndarray, width: int) -> np.ndarray:
    """Another hash of the windows at ``at``."""
    starts, ends, _ = tk.words(block.raw, block.off, tk.SPACED)
    return tk.windows(tk.word_hashes(block.raw, starts, ends, 1), width)[at]


#: Columns of what is sent: their numbers, and whether those rise.
_TYPES = {"place": ("<u4", True), "hash": ("<u8", False), "second": ("<u8", False), "order": ("<i8", True), "start": ("<u4", True)}
_SENT = "kind int, shard int, blk long, n int, " + ", ".join(f"{c} binary" for c in _TYPES)


def _sent(blocks: DataFrame, width: int, shards: int) -> DataFrame:
    """Kind 0: a shard's part of a block's windows, each once; kind 1: windows that the block itself has earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in opened(batches):
            hashes, at, word_off = _windows(block, width)
            held, _ = maybe_repeated(hashes, answers, shards)
            hashes, at = sent_hash(hashes[held]), at[held]
            if not len(at):
                continue
            second = sent_hash(_second(block, at, width))
            doc = np.searchsorted(word_off, at, side="right") - 1
            of = {"place": at, "hash": hashes, "second": second, "order": block.order[doc], "start": at - word_off[doc]}
            first = first_of(of["order"], of["start"], same(hashes, second))
            shard = np.where(first, shard_of(hashes, shards), -1)
            by = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[by], np.arange(-1, shards + 1))
            rows = [(int(s < 0), s, by[i:j]) for s, i, j in zip(range(-1, shards), cut[:-1], cut[1:], strict=True) if j > i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([block.blk] * len(rows), pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int32()),
                    *[pa.array([squeezed(of[c][r[2]].astype(t), rising) if c == "place" or not r[0] else None for r in rows], pa.binary()) for c, (t, rising) in _TYPES.items()],
                ],
                [c.split()[0] for c in _SENT.split(", ")],
            )

    return blocks.mapInArrow(run, _SENT)


def _later(sent: DataFrame, shards: int) -> DataFrame:
    """blk and answer (n, place): windows that start earlier in another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches, "shard"):
            of = {c: np.concatenate([spread(r[c], r["n"], *t) for r in rows]) for c, t in _TYPES.items()}
            later = ~first_of(of["order"], of["start"], same(of["hash"], of["second"]))
            cut = np.concatenate([[0], np.cumsum([r["n"] for r in rows])])
            out = [(r["blk"], of["place"][i:j][later[i:j]]) for r, i, j in zip(rows, cut[:-1], cut[1:], strict=True) if later[i:j].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([len(o[1]) for o in out], pa.int32()), pa.array([squeezed(o[1]) for o in out], pa.binary())], ["blk", "n", "place"])

    rows = sent.where("kind = 0").repartition(shards, "shard").sortWithinPartitions("shard", "blk")
    return rows.mapInArrow(run, "blk long, n int, place binary").select("blk", F.struct("n", "place").alias("answer"))


def removed(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left, joined by one space."""
    blocks = with_copies(packed(docs, id_col, text_col))
    shards = shards_of(blocks)
    maybe = prefiltered(blocks, lambda b: _windows(b, width)[0], shards)
    sent = written(_sent(answered(blocks, maybe), width, shards), "windows")
    own = sent.where("kind = 1").select("blk", F.struct("n", "place").alias("answer"))
    gone = own.unionByName(_later(sent, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in opened(batches):
            starts, ends, word_off = tk.words(block.raw, block.off, tk.SPACED)
            change = np.zeros(word_off[-1] + 1, np.int64)
            for a in answers:
                place = spread(a["place"], a["n"], "<u4").astype(np.int64)
                np.add.at(change, place, 1)
                np.add.at(change, place + width, -1)
            out = (np.cumsum(change[:-1]) > 0) | np.repeat(block.copy & (np.diff(word_off) >= width), np.diff(word_off))
            total = np.concatenate([[0], np.cumsum(out)])
            n_removed = total[word_off[1:]] - total[word_off[:-1]]
            data = block.raw.tobytes()
            kept = []
            for d, (i, j) in enumerate(zip(word_off[:-1], word_off[1:], strict=True)):
                text = data[block.off[d] : block.off[d + 1]]
                if n_removed[d]:
                    here = np.flatnonzero(~out[i:j]) + i
                    kept.append(b" ".join([data[a:b] for a, b in zip(starts[here].tolist(), ends[here].tolist(), strict=True)]).decode())
                else:
                    kept.append(b" ".join(text.split()).decode())
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(np.diff(word_off)), pa.array(n_removed), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return answered(blocks, gone).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start earlier."""
    return removed(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
