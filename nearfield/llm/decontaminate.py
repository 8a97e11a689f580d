"""Benchmark decontamination with a distributed positional inverted index.

``index`` turns runs of documents into index blocks, one row each: for every
term its positions, sorted.  Blocks are stored in the shared folder, and a
block answers queries on its own, so no posting list is ever gathered over the
corpus, however common its term.  A phrase is looked up from its rarest term:
that term's positions, less its place in the phrase, are the candidates, and
the lists of the other terms, rarest first, cut them down.

Terms are 64-bit hashes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
A-Z are lower-cased.  The queries are broadcast in rounds of at most
``ROUND_WORDS`` words; a larger benchmark takes more rounds over the index.

Edge cases: a null or empty text has no words; an item without words has no
window; an item whose id is null counts under the empty id; a null document id
stays null; repeated rows give repeated rows; other columns are ignored,
whatever their names; empty tables give an empty result, or one without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import load, text_of, written

#: Words of a window.
WIDTH = 10
#: Words of query items that one round broadcasts at most, unless one item has more.
ROUND_WORDS = 4_000_000
_INDEX = "doc_ids array<{id}>, n_words array<int>, terms array<long>, sizes array<int>, places binary"


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, raw, off in tk.chunks(column):
        raw = tk.lowered(raw)
        starts, ends, word_off = tk.words(raw, off, tk.PLAIN)
        yield first, end, tk.word_hashes(raw, starts, ends), word_off


def index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index blocks of all documents; with ``terms`` (sorted hashes), of those terms only.

    A place is the number of a word in its block.  ``places`` has those of the
    first term, then of the second and so on, as 32-bit numbers.
    """
    df = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    wanted = None if terms is None else df.sparkSession.sparkContext.broadcast(terms)
    schema = _INDEX.format(id=df.schema["doc_id"].dataType.simpleString())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        if known is not None:
            some = np.zeros(1 << 20, bool)
            some[(known & np.uint64(len(some) - 1)).astype(np.int64)] = True
        for b in batches:
            for first, end, hashes, word_off in _terms(b.column(1)):
                if known is None:
                    vocabulary, which = np.unique(hashes, return_inverse=True)
                    places = np.arange(len(hashes))
                else:
                    places = np.flatnonzero(some[(hashes & np.uint64(len(some) - 1)).astype(np.int64)])
                    which = np.searchsorted(known, hashes[places])
                    held = known[np.minimum(which, len(known) - 1)] == hashes[places] if len(known) else np.zeros(len(places), bool)
                    places, which, vocabulary = places[held], which[held], known
                order = np.argsort(which, kind="stable")
                sizes = np.bincount(which, minlength=len(vocabulary))
                here = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(0).slice(first, end - first).to_pylist()], pa.list_(b.column(0).type)),
                        pa.array([np.diff(word_off).astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([vocabulary[here].view(np.int64)], pa.list_(pa.int64())),
                        pa.array([sizes[here].astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([places[order].astype("<u4").tobytes()], pa.binary()),
                    ],
                    ["doc_ids", "n_words", "terms", "sizes", "places"],
                )

    return df.mapInArrow(build, schema)


class Block:
    """A block of the index, opened."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.word_off = np.concatenate([[0], np.cumsum(self.n_words)])
        self.terms = np.asarray(row["terms"], np.int64)
        order = np.argsort(self.terms.view(np.uint64))
        assert (order == np.arange(len(order))).all()
        self.terms = self.terms.view(np.uint64)
        self.list_off = np.concatenate([[0], np.cumsum(np.asarray(row["sizes"], np.int64))])
        self.places = np.frombuffer(row["places"], "<u4").astype(np.int64)
        self.at = np.full(int(self.word_off[-1]), -1, np.int32)
        self.at[self.places] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.list_off))

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this block's vocabulary, -1 where it isn't."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        k = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[k] == terms, k, -1)

    def postings(self, number: int) -> np.ndarray:
        return self.places[self.list_off[number] : self.list_off[number + 1]]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_off, places, side="right") - 1


class Phrases:
    """Distinct phrases of at most WIDTH terms, each with its terms' order from the rarest."""

    def __init__(self, windows: list[np.ndarray], counts: dict[int, int]) -> None:
        self.length = np.array([len(w) for w in windows], np.int64)
        self.terms = np.zeros((len(windows), max([1, *self.length])), np.uint64)
        often = np.full(self.terms.shape, np.iinfo(np.int64).max)
        for k, w in enumerate(windows):
            self.terms[k, : len(w)] = w
            often[k, : len(w)] = [counts.get(int(t), 0) for t in w]
        self.order = np.argsort(often, axis=1, kind="stable")

    def found(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first place) of every exact occurrence in one document of the block."""
        used = np.arange(self.terms.shape[1])[None, :] < self.length[:, None]
        numbers = np.where(used, block.numbers(self.terms), 0)
        alive = np.flatnonzero((numbers >= 0).all(1))
        rare = self.order[alive, 0]
        own = numbers[alive, rare]
        size = block.list_off[own + 1] - block.list_off[own]
        phrase = np.repeat(alive, size)
        inner = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size)
        start = block.places[np.repeat(block.list_off[own], size) + inner] - np.repeat(rare, size)
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        doc = block.doc_of(start) if len(start) else start
        ok = start + self.length[phrase] <= block.word_off[doc + 1]
        phrase, start = phrase[ok], start[ok]
        for step in range(1, self.terms.shape[1]):  # the lists of the rarer terms cut first
            if not len(phrase):
                break
            offset = self.order[phrase, step]
            more = step < self.length[phrase]
            place = np.where(more, start + offset, start)
            ok = ~more | (block.at[place] == numbers[phrase, offset])
            phrase, start = phrase[ok], start[ok]
        return phrase, start


def near(block: Block, terms: np.ndarray, within: int) -> np.ndarray:
    """First places of the shortest runs of at most ``within`` words of one document that hold all the terms.

    From the rarest term: every other term must stand less than ``within``
    words from one of its places; what is left is merged and walked once.
    """
    numbers = block.numbers(np.unique(terms))
    if not len(numbers) or (numbers < 0).any():
        return np.zeros(0, np.int64)
    lists = sorted((block.postings(n) for n in numbers), key=len)
    anchor = lists[0]
    for other in lists[1:]:
        k = np.searchsorted(other, anchor - within + 1)
        close = other[np.minimum(k, len(other) - 1)]
        anchor = anchor[(k < len(other)) & (close < anchor + within)]
    if not len(anchor):
        return anchor
    kept = []
    for n, places in enumerate(lists):
        k = np.searchsorted(anchor, places - within + 1)
        places = places[(k < len(anchor)) & (anchor[np.minimum(k, len(anchor) - 1)] < places + within)]
        kept.append(np.stack([places, np.full(len(places), n)]))
    place, which = np.concatenate(kept, axis=1)
    order = np.argsort(place)
    last = np.full(len(lists), -1)
    out = []
    for p, n in zip(place[order], which[order], strict=True):
        last[n] = p
        low = last.min()
        if low >= 0 and p - low < within and block.doc_of(np.array([low]))[0] == block.doc_of(np.array([p]))[0]:
            out.append(low)
    return np.unique(out).astype(np.int64)


def item_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, n (its words) and window, the hashes of ``width`` words that follow each other, or of all where there are fewer."""
    df = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), text_of(items, text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, hashes, word_off in _terms(b.column(1)):
                for k in range(end - first):
                    own = hashes[word_off[k] : word_off[k + 1]].view(np.int64)
                    if len(own):
                        rows = [own[i : i + width] for i in range(max(1, len(own) - width + 1))]
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[first + k].as_py()] * len(rows)), pa.array(rows, pa.list_(pa.int64()))], ["item", "window"])

    return df.mapInArrow(cut, "item string, window array<long>").distinct()


def _rounds(windows: DataFrame) -> list[DataFrame]:
    """The windows with their items, in rounds of bounded size; one round at least."""
    per = written(windows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")), "bench")
    words = per.agg(F.sum(F.size("window") + F.size("items"))).first()[0] or 0
    n = max(1, -(-words // ROUND_WORDS))
    return [per.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def _merged(start: np.ndarray, stop: np.ndarray) -> int:
    """Places that the runs cover."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    return int((stop - np.maximum(start, np.concatenate([[0], stop[:-1]]))).clip(0).sum())


def hits(blocks: DataFrame, rows: list, counts: dict[int, int], last: bool = False) -> DataFrame:
    """The summary, if this is all, or else key, doc_id, n_words, runs (start and end, by turns, of hit words in the document) and items of every document."""
    sc = blocks.sparkSession.sparkContext
    phrases = sc.broadcast(Phrases([np.array(r["window"], np.int64).view(np.uint64) for r in rows], counts))
    owners = sc.broadcast([r["items"] for r in rows])
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                block = Block({n: b.column(n)[row].as_py() if n == "places" else b.column(n)[row].values.to_pylist() if n == "doc_ids" else b.column(n)[row].values.to_numpy(zero_copy_only=False) for n in b.schema.names if n != "key"})
                phrase, start = phrases.value.found(block)
                doc = block.doc_of(start) if len(start) else start
                order = np.argsort(doc, kind="stable")
                phrase, start, doc = phrase[order], start[order], doc[order]
                cut = np.searchsorted(doc, np.arange(len(block.n_words) + 1))
                key = b.column("key")[row].as_py()
                runs, items = [], []
                for d in range(len(block.n_words)):
                    p, s = phrase[cut[d] : cut[d + 1]], start[cut[d] : cut[d + 1]] - block.word_off[d]
                    runs.append(np.stack([s, s + phrases.value.length[p]], axis=1).ravel())
                    items.append(sorted({i for k in np.unique(p) for i in owners.value[k]}))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{key}:{d}" for d in range(len(runs))], pa.string()), pa.array(block.doc_ids, b.schema.field("doc_ids").type.value_type), pa.array(block.n_words), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                    ["key", "doc_id", "n_words", "runs", "items"],
                )

    if last:
        return blocks.mapInArrow(lambda batches: _sums(answer(batches)), _SUMMARY.format(id=id_type))
    return blocks.mapInArrow(answer, f"key string, doc_id {id_type}, n_words long, runs array<long>, items array<string>")


_SUMMARY = "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit, n_items, items_sha256 and contaminated, of documents with all their runs and items."""
    for b in batches:
        hit = []
        for r in b.column("runs"):
            v = r.values.to_numpy(zero_copy_only=False).reshape(-1, 2) if len(r) else np.zeros((0, 2), np.int64)
            hit.append(_merged(v[:, 0], v[:, 1]) if len(v) else 0)
        items = [sorted(set(x)) for x in b.column("items").to_pylist()]
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rounds = _rounds(item_windows(items, width))
    parts, blocks = [], None
    for k, part in enumerate(rounds):
        rows = part.collect()
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.array(r["window"], np.int64).view(np.uint64) for r in rows]))
        if not k:  # one index for all rounds: of the benchmark's terms, or of all where those don't fit a round
            blocks = written(index(docs, terms if len(rounds) == 1 else None), "postings")
            blocks = blocks.withColumn("key", F.concat_ws("-", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string")))
        listed = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("z")).select("z.terms", "z.sizes")
        known = docs.sparkSession.createDataFrame(pa.table({"terms": pa.array(terms.view(np.int64))}))
        counts = listed.join(F.broadcast(known), "terms", "left_semi").groupBy("terms").agg(F.sum("sizes").alias("n"))
        parts.append(hits(blocks, rows, {r["terms"] & ((1 << 64) - 1): r["n"] for r in counts.collect()}, len(rounds) == 1))  # the round's terms at most
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
    return every.drop("key").mapInArrow(_sums, _SUMMARY.format(id=every.schema["doc_id"].dataType.simpleString()))


def kept(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the contaminated ones.

    The verdict is of a row, not of its id: rows are told apart by id and text,
    so that null or repeated ids take no clean row along.
    """
    key = F.xxhash64(docs[id_col], text_of(docs, text_col))
    keyed = docs.select(key.alias("doc_id"), text_of(docs, text_col).alias("text"))
    bad = decontaminated(keyed, items, width).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key == F.col("_bad"), "left_anti")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    return decontaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
