"""Toxicity by weak supervision.

1. Lexicon voters are mined from labelled rows: words and word beginnings that
   toxic documents have and others don't.  Pattern voters look at how many
   lexicon entries a text has, how dense they are, and at shouting.
2. A generative label model takes the votes, and the label as one more voter,
   as noisy signs of a hidden class.  It estimates each voter's accuracy, the
   label's too, by expectation and maximisation, and correlations of voters
   within a class; correlated voters share their weight.
3. A linear classifier is trained on the posterior labels and scores every
   document; labels, languages, sources and ids are not inputs of a score.

Fitting uses at most ``FIT_ROWS`` labelled rows, in one task; everything else
runs over all documents, without a shuffle.

Edge cases: a null or empty text has the score of a text without votes; a very
long text is scored whole; a null id is scored, and neither held out nor fitted
on; an id with several labels has the highest, and one with several texts is
fitted on the first by code points, once; repeated rows give repeated rows, of
equal scores; entries that tell the classes apart equally well are taken by their
hash; other columns are ignored, whatever their names; without usable labels
every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import dropped, load, text_of, written

#: Labelled rows that the models are fitted on at most, the first by a hash of the id.
FIT_ROWS = 12_000
#: Lexicon voters at most.
VOTERS = 400
#: Toxic documents of the fitted ones that an entry is in at least.
SUPPORT = 4
#: Bytes of the word beginnings that count as entries; 0 is the whole word.
PREFIXES = (0, 4, 5, 6)
FOLDS = 5
_SALT = [np.uint64(x) for x in (0x51ED270B9A8C3F17, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _entries(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, entry hash) of every word and word beginning; a word no longer than a beginning has none."""
    raw = tk.lowered(raw)
    starts, ends, word_off = tk.words(raw, off, tk.PLAIN)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
    for salt, size in zip(_SALT, PREFIXES, strict=True):
        long = ends - starts > size
        cut = starts[long] + size if size else ends
        yield doc[long], tk.word_hashes(raw, starts[long], cut) ^ salt


@dataclass
class Model:
    """Entries (sorted hashes) and the classifier's weights: one an entry, then the patterns', then the constant."""

    entries: np.ndarray
    weights: np.ndarray

    def features(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, voter) of every vote of the lexicon, without repeats, and the pattern features."""
        n = len(off) - 1
        rows, voters, hits = [], [], np.zeros(n)
        if len(self.entries):
            some = np.zeros(1 << 16, bool)
            some[(self.entries & np.uint64(0xFFFF)).astype(np.int64)] = True
            for doc, h in _entries(raw, off):
                k = np.flatnonzero(some[(h & np.uint64(0xFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.entries, h[k]), len(self.entries) - 1)
                held = self.entries[at] == h[k]
                rows.append(doc[k][held])
                voters.append(at[held])
                hits += np.bincount(doc[k][held], minlength=n)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]) * max(1, len(self.entries)) + np.concatenate([np.zeros(0, np.int64), *voters]))
        doc, voter = np.divmod(pairs, max(1, len(self.entries)))
        n_words = np.maximum(1, np.diff(tk.words(raw, off, tk.SPACED)[2]))
        total = np.concatenate([[0], np.cumsum(raw == ord("!"))])
        shout = (total[off[1:]] - total[off[:-1]]) / n_words
        kinds = np.bincount(doc, minlength=n)
        patterns = np.stack([kinds >= 1, kinds >= 2, kinds >= 4, hits / n_words >= 0.004, hits / n_words >= 0.02, shout >= 0.2], axis=1).astype(float)
        return doc, voter, patterns

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        doc, voter, patterns = self.features(raw, off)
        m = len(self.entries)
        z = self.weights[-1] + patterns @ self.weights[m:-1] + np.bincount(doc, self.weights[voter], minlength=len(off) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


N_PATTERNS = 6


#: How often the given label is taken to be wrong at first, in either class; and of how many rows that counts as seen.
LABEL_NOISE, NOISE_ROWS = 0.02, 50


@dataclass
class Labels:
    """What the label model finds: every row's probability of the toxic class; how often each voter votes in either class; their correlations within a class; and how often the label is wrong in either class."""

    posterior: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    noise: tuple[float, float]


def label_model(votes: np.ndarray, label: np.ndarray, steps: int = 25) -> Labels:
    """The hidden class behind votes (0 or 1) and labels.

    Given the class, every voter, and the label, votes with its own probability;
    a voter whose votes correlate with others' given the class counts as
    1 / (1 + sum of those correlations) of a voter.  The label keeps the classes
    what they are: it starts out as nearly right, and is never taken to be wrong in
    more than a third of a class.
    """
    votes = votes.astype(float)
    noise = np.array([LABEL_NOISE, LABEL_NOISE])
    post = np.where(label > 0, 1 - LABEL_NOISE, LABEL_NOISE)
    corr = np.eye(votes.shape[1])
    for _ in range(steps):
        share = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        p1 = (post @ votes + 0.5 * votes.mean(0) + 0.01) / (post.sum() + 1)
        p0 = ((1 - post) @ votes + 0.01) / ((1 - post).sum() + 1)
        wrong = np.array([post @ (label <= 0), (1 - post) @ (label > 0)])
        noise = np.clip((wrong + LABEL_NOISE * NOISE_ROWS) / (np.array([post.sum(), (1 - post).sum()]) + NOISE_ROWS), 1e-3, 1 / 3)
        centred = votes - np.outer(post, p1)
        centred -= np.outer(1 - post, p0)
        cov = centred.T @ centred / len(votes)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / sd[:, None] / sd, 0, 1)
        corr[corr < 0.1] = 0
        np.fill_diagonal(corr, 1)
        weight = 1 / corr.sum(1)
        said = np.where(label > 0, np.log((1 - noise[0]) / noise[1]), np.log(noise[0] / (1 - noise[1])))
        absent = np.log((1 - p1) / (1 - p0))
        log = np.log(share / (1 - share)) + said + votes @ (weight * (np.log(p1 / p0) - absent)) + weight @ absent
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-4:
            break
    return Labels(post, p1, p0, corr, (float(noise[0]), float(noise[1])))


def linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the constant last, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts and labels of at most FIT_ROWS ids that aren't held out, each once."""
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("text"))
    found = rows.join(F.broadcast(known), F.col("_id") == known["doc_id"])
    return found.groupBy("_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def mined(sample: DataFrame) -> np.ndarray:
    """Hashes of the lexicon's entries, sorted: those that tell the classes apart best."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            for first, _, raw, off in tk.chunks(b.column(1)):
                for doc, h in _entries(raw, off):
                    pairs = np.unique(np.rec.fromarrays([h, doc]))
                    entry, at = np.unique(pairs["f0"], return_inverse=True)
                    toxic = np.bincount(at, y[first + pairs["f1"]], minlength=len(entry)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(entry)).astype(np.int64) - toxic)], ["entry", "toxic", "clean"])

    totals = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    n1, n0 = totals[0], totals[1] - totals[0]
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    found = sample.mapInArrow(emit, "entry long, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= SUPPORT)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    best = found.withColumn("odds", odds).where(F.col("odds") > 2.0).orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "entry").limit(VOTERS)
    return np.sort(np.array([r["entry"] for r in best.collect()], np.int64).view(np.uint64))


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model; one task fits it on the votes of at most FIT_ROWS rows, and the driver gets its weights."""
    sample = written(_sample(docs, labels, id_col, text_col), "tox-sample")
    entries = mined(sample)
    empty = Model(entries, np.append(np.zeros(len(entries) + N_PATTERNS), -30.0))
    if not len(entries):
        dropped(sample)
        return empty

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, raw, off in tk.chunks(b.column(1)):
                doc, voter, patterns = empty.features(raw, off)
                cut = np.searchsorted(doc, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(voter, pa.int32()))
                bits = (patterns.astype(np.int64) << np.arange(N_PATTERNS)).sum(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), lists, pa.array(bits)], ["y", "voters", "bits"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[2], r[1]))  # so that a rerun fits the same numbers
        votes = np.zeros((len(rows), len(entries) + N_PATTERNS), np.uint8)
        for k, (_, voters, bits) in enumerate(rows):
            votes[k, voters] = 1
            votes[k, len(entries) :] = (bits >> np.arange(N_PATTERNS)) & 1
        label = np.array([r[0] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([linear(votes, label_model(votes, label).posterior)])], ["weights"])

    votes = sample.mapInArrow(vote, "y int, voters array<int>, bits long").repartition(1)
    weights = votes.mapInArrow(fit, "weights array<double>").first()
    dropped(sample)
    return Model(entries, np.array(weights["weights"])) if weights else empty


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; no shuffle."""
    df = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), text_of(docs, text_col).alias("text"))
    own = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [own.value.scores(raw, off) for _, _, raw, off in tk.chunks(b.column(2))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the documents that the model rejects; no shuffle."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [own.value.scores(raw, off) < 0.5 for _, _, raw, off in tk.chunks(b.column(at))]
            if parts:
                yield b.filter(pa.array(np.concatenate(parts)))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document."""
    docs = load(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, load(spark, sf_dir, "labels")))
