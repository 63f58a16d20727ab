"""Quality classifier: accuracies of overlapping heuristic labellers by expectation-maximisation, then a hashed linear scorer.

No label is used. Each labeller says good, bad or nothing about a whole text. Their accuracies and
dependencies are estimated over the counts of all documents' vote patterns; the label model's posteriors
are the targets of a linear scorer over hashed words, word shapes and word endings (as shares of a
text's words), which then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, Sums, doc_key, map_batches, mix, raw, text_of, words
from .label_model import LabelModel, Scorer, decode, fit_label_model, fit_scorer, pattern_counts, sampled

BITS = 18
#: Documents that the scorer is fitted on, about; whole texts, as hashed features.
SAMPLE_DOCS = 5000
#: Function words of four languages, by which a labeller tells running text.
FUNCTION_WORDS = "the of and to in is that it for was on are as with be at by this from a der die das und ist in den von zu mit sich des auf im nicht ein eine le la les de et des en un une du que est pour dans qui par el los las y que en un una por con para es se del al".split()

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")
_LETTER = np.isin(_SHAPE, [ord("a"), ord("A")])
_UPPER = _SHAPE == ord("A")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\^~=+@_"]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:;\"')"]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and share of the features of every word: itself, its shape, its last two bytes' shape, whether it repeats the word before."""
    data, offs = raw(texts)
    start, end, row = words(data, offs)
    if not len(start):
        return row, row, row.astype(float)
    shape = Sums(_SHAPE[data])
    last = shape.ranges(np.maximum(start, end - 2), end)
    whole = mix(shape.ranges(start, np.minimum(end, start + 3)) * np.uint64(3) + last + np.minimum(end - start, 15).astype(np.uint64))
    word = Sums(LOWER[data]).ranges(start, end)
    again = mix(np.concatenate([[False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])]).astype(np.uint64) + np.uint64(77))
    hashes = np.concatenate([word, whole, last * np.uint64(5), again])
    share = 1.0 / np.bincount(row, minlength=len(texts))[row]
    return np.tile(row, 4), (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.tile(share, 4)


def _says(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0))


#: How many labellers there are; so at most 3**13 patterns of votes.
LABELLERS = 13


def labeller_votes(texts: pa.Array) -> np.ndarray:
    """Votes of the labellers, 1 for good and -1 for bad, one column each."""
    data, offs = raw(texts)
    n = len(texts)
    start, end, row = words(data, offs)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    size = np.bincount(row, end - start, n)
    of = lambda mask: np.bincount(np.searchsorted(offs, np.flatnonzero(mask[data]), "right") - 1, minlength=n)[:n]
    letters, symbols = of(_LETTER) / np.maximum(size, 1), of(_SYMBOL) / some
    hashes = Sums(LOWER[data]).ranges(start, end)
    known = Sums(np.frombuffer(" ".join(FUNCTION_WORDS).encode(), np.uint8))
    s, e, _ = words(np.frombuffer(" ".join(FUNCTION_WORDS).encode(), np.uint8), np.array([0, len(" ".join(FUNCTION_WORDS))]))
    function = np.bincount(row, np.isin(hashes, known.ranges(s, e)), n) / some
    strange = np.bincount(row, (_SYMBOL[data[end - 1]]) if len(end) else None, n) / some
    lone = np.bincount(row, ((end - start == 1) & _SYMBOL[data[start]]) if len(end) else None, n) / some
    mean = size / some
    upper, shouts = of(_UPPER) / np.maximum(size, 1), (np.bincount(row, (data[end - 1] == 33) if len(end) else None, n) / some)
    again = np.bincount(row[1:], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), n) / some if len(hashes) else np.zeros(n)
    pair = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) else hashes
    inside = row[:-1][row[:-1] == row[1:]]
    pair = pair[row[:-1] == row[1:]]
    kinds = np.bincount(np.unique(np.stack([inside.astype(np.uint64), pair], 1), axis=0)[:, 0].astype(np.int64), minlength=n) if len(pair) else np.zeros(n)
    variety = kinds / np.maximum(np.bincount(inside, minlength=n), 1)
    ends = np.zeros(n)
    repeats = np.zeros(n)
    for i, t in enumerate(texts.to_pylist()):
        lines = [x.strip() for x in t.split("\n") if x.strip()]
        ends[i] = sum(x[-1] in ".!?:;\"')" for x in lines) / max(len(lines), 1)
        repeats[i] = 1 - len(set(lines)) / max(len(lines), 1)
    return np.stack(
        [
            _says(symbols > 0.3, symbols < 0.02), _says(letters < 0.8, letters > 0.93), _says((function < 0.05) & (count >= 30), function > 0.12), _says(strange > 0.2, strange < 0.01),
            _says(lone > 0.1, (lone < 0.005) & (count >= 30)), _says((mean < 2.5) | (mean > 12), (mean > 3.5) & (mean < 8.5)), _says(variety < 0.5, (variety > 0.8) & (count >= 50)),
            _says(ends < 0.2, ends > 0.8), _says(repeats > 0.4, np.zeros(n, bool)), _says(count < 20, count >= 60),
            _says(upper > 0.4, upper < 0.15), _says(shouts > 0.2, shouts < 0.02), _says(again > 0.15, again < 0.03),
        ], 1)


def compact(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features with the shares of one bucket of a text added up."""
    row, bucket, share = features(texts)
    if not len(row):
        return row, bucket, share
    key, at = np.unique(row << BITS | bucket, return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(at, share)


def learn(docs: DataFrame, sample: int = SAMPLE_DOCS) -> tuple[Scorer, LabelModel] | None:
    """A scorer and its label model; None without any text.

    The label model sees the votes of all documents; the scorer is fitted on about `sample` of them,
    chosen by the hash of doc_id and text.
    """
    rows = docs.where("text is not null").select(F.pmod(F.xxhash64(doc_key(), "text"), F.lit(1 << 30)).alias("h"), F.col("text").cast("string").alias("text"))
    codes, counts = pattern_counts(rows, labeller_votes)
    if not len(codes):
        return None
    votes = decode(codes, LABELLERS)
    voters = fit_label_model(votes, counts, accuracy=0.75, prior=0.8)
    rate = min(1.0, sample / counts.sum())
    return fit_scorer(sampled(rows, labeller_votes, compact, voters, (rate, rate), 2 * sample), 1 << BITS, lasso=1e-5), voters


def score_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: better), kept (score >= least).

    A null text, or one without words, has score 0. Repeated rows, null ids, an empty table and
    further columns need no care.
    """
    model = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model[0] if model else None)

    def run(batch: pa.RecordBatch):
        n = batch.num_rows
        score = np.zeros(n)
        if shared.value is not None:
            rows, buckets, values = features(text_of(batch))
            some = np.bincount(rows, minlength=n) > 0
            score[some] = shared.value.probability(rows, buckets, values, n)[some]
        yield {"doc_id": batch.column(0), "score": pa.array(score, pa.float64()), "kept": pa.array(score >= least)}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, "doc_id long, score double, kept boolean")
