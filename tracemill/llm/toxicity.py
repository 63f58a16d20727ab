"""Toxicity: lexicon and pattern voters, a generative label model over them, and a hashed linear classifier of its posteriors.

Lexicons are families of word forms with one stem. Stems are mined from a bounded sample of labelled
texts, so that no list per language is needed; that, and the values with which the estimation starts, is
all that labels are used for. The label model estimates the voters' accuracies and dependencies from the
vote patterns of all documents that aren't held out, without labels. A linear classifier over the
distinct words of a text and their beginnings is trained on the posteriors alone and scores every whole
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .kernels import Sums, crc_mod, doc_key, map_batches, raw, text_of, words
from .label_model import LabelModel, Scorer, decode, fit_label_model, fit_scorer, pattern_counts, posteriors, sampled

BITS = 20
#: Labelled rows that lexicons are mined from at most, toxic and other ones; and rows that the classifier is fitted on, about, of each class.
MINED_TOXIC, MINED_OTHER, FITTED = 3000, 6000, 3000
#: Lexicon voters (so at most 2**23 patterns of votes, with six pattern voters), and stems that are dealt to them.
LEXICONS, STEMS = 17, 64
#: A stem's least number of toxic texts, and the least share of toxic texts among those with it (lower bound of a 95 % interval).
LEAST, SURE = 5, 0.55
#: Bytes of the word beginnings that may be stems, and how many words of a text have to begin so, at most.
BEGINNINGS, FORMS = (4, 5, 6, 7), 3
#: Soft threshold of the classifier's weights.
LASSO = 1e-4

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _once(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the first of each distinct (row, value)."""
    order = np.lexsort((value, row))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    return order[new]


def _forms(texts: pa.Array, beginnings: tuple[int, ...]):
    """Row, hash, start and end of each text's distinct words, then of their beginnings; and the lower-cased bytes."""
    data, offs = raw(pc.utf8_lower(texts))
    start, end, row = words(data, offs, _NO_LETTER)
    if not len(start):
        return row, row.astype(np.uint64), start, end, data
    sums = Sums(data)
    whole = sums.ranges(start, end)
    one = _once(row, whole)
    start, end, row, whole = start[one], end[one], row[one], whole[one]
    parts = [(row, whole, start, end)]
    for k in beginnings:
        on = end - start > k
        parts.append((row[on], sums.ranges(start[on], start[on] + k) * np.uint64(2 * k + 1), start[on], start[on] + k))
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), data


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, None]:
    """Row and bucket of the features: each distinct word of a text, its first four and its first five bytes."""
    row, hashes, *_ = _forms(texts, (4, 5))
    return row, (hashes >> np.uint64(64 - BITS)).astype(np.int64), None


def _units(texts: pa.Array):
    """Row, hash, start and end of what may be a stem, once for each text: a word, or a beginning that 1, 2 or 3 of its words have; and the bytes."""
    row, hashes, start, end, data = _forms(texts, BEGINNINGS)
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = np.flatnonzero(new)
    n, at = np.diff(first, append=len(order)), order[first]
    parts = [(row[at[n >= k]], hashes[at[n >= k]] * np.uint64(2 * k - 1), start[at[n >= k]], end[at[n >= k]]) for k in range(1, FORMS + 1)]
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), data


#: Pattern voters: expression, how often it has to occur, and the vote.
_PATTERNS = [
    (r"!{2,}", 2, 1),  # exclamation
    (r"\b[A-Z]{4,}\b", 5, 1),  # shouting
    (r"(?i)\b(?:you|du|ihr|tu|vous|usted)\b[^.!?\n]{0,40}!", 1, 1),  # an address with an exclamation
    (r"(?i)\b[a-z]{1,3}[*#@$]{2,}[a-z]{0,3}\b", 1, 1),  # letters struck out
    (r"[|{}<>=\\]", 10, -1),  # tables and markup
    (r"[^.!?\n]{20,}\.", 3, -1),  # sentences without emphasis
]


@dataclass
class Voters:
    """Hashes of the stems, sorted, with the lexicon of each; their texts, for reading; the share of toxic labels; P(votes | toxic) / P(votes | not), by voter, as a guess; and the group of each voter, or -1."""

    stem: np.ndarray
    lexicon: np.ndarray
    texts: list[list[str]]
    prior: float
    ratio: np.ndarray
    group: np.ndarray

    def votes(self, texts: pa.Array) -> np.ndarray:
        """1 where a lexicon's stem occurs, and the signs of the pattern voters; else 0."""
        out = np.zeros((len(texts), LEXICONS + len(_PATTERNS)), np.int8)
        row, hashes, *_ = _units(texts)
        if len(self.stem) and len(row):
            k = np.minimum(np.searchsorted(self.stem, hashes), len(self.stem) - 1)
            hit = self.stem[k] == hashes
            out[row[hit], self.lexicon[k[hit]]] = 1
        for j, (pattern, least, sign) in enumerate(_PATTERNS):
            out[:, LEXICONS + j] = sign * (np.asarray(pc.count_substring_regex(texts, pattern)) >= least)
        return out


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, other: int) -> tuple[DataFrame, dict[int, int], dict[int, int]] | None:
    """A written sample (text, toxic) of labelled rows that aren't held out, how many of each class it was drawn from and holds."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id", crc_mod(5).alias("m")).where("m <> 0 and doc_id is not null").select("doc_id").distinct().join(marks, "doc_id")
    n = {r["toxic"]: r["count"] for r in ids.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    h = F.pmod(F.xxhash64(doc_key()), F.lit(1 << 30))
    some = lambda c, most: ids.where((F.col("toxic") == c) & (h + 0.0 < min(1.0, 1.1 * most / n[c]) * (1 << 30))).orderBy(h, "doc_id").limit(most).select("doc_id", "toxic")
    chosen = some(1, toxic).unionByName(some(0, other))  # 9,000 ids at most
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").distinct()
    texts = checkpointed(texts.select("text", "toxic"))
    return texts, n, {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}


def _texts_with(sample: DataFrame, toxic: int, wanted: np.ndarray | None, spell: bool = False) -> DataFrame:
    """(hash, n) for units of the sampled texts of a class: how many have them; with their bytes if they are to be spelled."""
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch):
        _, hashes, start, end, data = _units(text_of(batch))
        if shared.value is not None:
            hit = np.isin(hashes, shared.value)
            hashes, start, end = hashes[hit], start[hit], end[hit]
        value, at, n = np.unique(hashes, return_index=True, return_counts=True)
        out = {"hash": pa.array(value.view(np.int64)), "n": pa.array(n, pa.int64())}
        yield out | ({"form": pa.array([data[a:b].tobytes() for a, b in zip(start[at], end[at], strict=True)], pa.binary())} if spell else {})

    rows = map_batches(sample.where(F.col("toxic") == toxic).select("text"), run, "hash long, n long" + (", form binary" if spell else ""))
    return rows.groupBy("hash").agg(F.sum("n").alias("n"), *([F.min("form").alias("form")] if spell else []))


def _holders(sample: DataFrame, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted stems each sampled text has (texts x stems), and whether it is toxic."""
    shared = sample.sparkSession.sparkContext.broadcast(stem)

    def run(batch: pa.RecordBatch):
        row, hashes, *_ = _units(text_of(batch))
        k = np.minimum(np.searchsorted(shared.value, hashes), len(shared.value) - 1)
        hit = shared.value[k] == hashes
        bits = np.zeros(batch.num_rows, np.uint64)
        np.bitwise_or.at(bits, row[hit], np.uint64(1) << k[hit].astype(np.uint64))
        yield {"bits": pa.array(bits.view(np.int64)), "toxic": batch.column(0)}

    found = map_batches(sample.select("toxic", "text"), run, "bits long, toxic int").toArrow()
    bits = np.asarray(found.column("bits"), np.int64).view(np.uint64)
    return (bits[:, None] >> np.arange(len(stem), dtype=np.uint64) & np.uint64(1)).astype(bool), np.asarray(found.column("toxic")) == 1


def _stems(hashes: np.ndarray, score: np.ndarray, sample: DataFrame) -> list[tuple[np.uint64, bytes]]:
    """Units by score, best first, without those that begin a better one or are begun by it."""
    order = np.argsort(-score, kind="stable")
    spelled = {np.int64(r.hash).view(np.uint64): bytes(r.form) for r in _texts_with(sample, 1, hashes, True).collect()}
    out: list[tuple[np.uint64, bytes]] = []
    for h in hashes[order]:
        form = spelled[h]
        if len(out) < STEMS and len(form) >= 3 and not any(form.startswith(s) or s.startswith(form) for _, s in out):
            out.append((h, form))
    return out


def _groups(fires: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Groups of lexicons that share many of the toxic texts (texts x lexicons), as those of one language do; -1 for a lexicon without any."""
    one = fires.astype(float)
    total = one.sum(0)
    near = (one.T @ one >= np.maximum(least * np.minimum.outer(total, total), 3)) | np.eye(len(total), dtype=bool)
    for _ in total:
        near = near @ near
    first = np.where(total > 0, near.argmax(1), -1)
    return np.searchsorted(np.unique(first[first >= 0]), first, "left") * (first >= 0) - (first < 0)


def mine(docs: DataFrame, labels: DataFrame, toxic: int = MINED_TOXIC, other: int = MINED_OTHER) -> Voters | None:
    """Voters whose lexicons are mined from a sample of labelled rows; None unless both classes are labelled.

    Stems are taken by toxic texts times log odds. All but the last lexicon begin with one of the best
    stems; each later stem joins the lexicon with which it shares most toxic texts, or the last one if
    it shares few with any.
    """
    drawn = _sample(docs, labels, toxic, other)
    if drawn is None:
        return None
    sample, n, held = drawn
    bad = _texts_with(sample, 1, None).where(F.col("n") >= LEAST).toArrow()
    hashes, bads = np.asarray(bad.column("hash"), np.int64).view(np.uint64), np.asarray(bad.column("n"), float)
    order = np.argsort(hashes)
    hashes, bads = hashes[order], bads[order]
    good = _texts_with(sample, 0, hashes).toArrow()
    goods = np.zeros(len(hashes))
    goods[np.searchsorted(hashes, np.asarray(good.column("hash"), np.int64).view(np.uint64))] = np.asarray(good.column("n"))
    alike = n[0] / max(held.get(0, 0), 1) / (n[1] / max(held.get(1, 0), 1))  # as if the classes had been drawn alike
    goods *= alike
    total = bads + goods
    share = bads / total
    sure = (share + 1.92 / total - 1.96 * np.sqrt(share * (1 - share) / total + 0.96 / total**2)) / (1 + 3.84 / total)
    score = bads * np.log((bads + 0.2) / (goods + 0.2) * n[0] / n[1])
    found = np.flatnonzero((sure >= SURE) & (score > 0))
    found = found[np.argsort(-score[found], kind="stable")]
    stems = _stems(hashes[found], score[found], sample)
    lexicon, ratio, group = np.arange(len(stems)), np.ones(LEXICONS + len(_PATTERNS)), np.full(LEXICONS + len(_PATTERNS), -1)
    order = np.argsort(np.array([h for h, _ in stems], np.uint64))
    stem = np.array([h for h, _ in stems], np.uint64)[order]
    if len(stems):
        holds, is_bad = _holders(sample, stem)
        holds = holds[:, np.argsort(order)]
        mine_ = holds[is_bad].astype(float)
        if len(stems) >= LEXICONS:
            both = (mine_.T @ mine_ / np.maximum(np.minimum.outer(mine_.sum(0), mine_.sum(0)), 1))[LEXICONS - 1 :, : LEXICONS - 1]
            lexicon[LEXICONS - 1 :] = np.where(both.max(1) >= 0.3, both.argmax(1), LEXICONS - 1)
        fires = np.stack([holds[:, lexicon == k].any(1) for k in range(LEXICONS)], 1)
        group[:LEXICONS] = _groups(fires[is_bad])
        for k in range(LEXICONS):
            hit = fires[:, k]
            ratio[k] = (hit[is_bad].sum() + 1) / (is_bad.sum() + 2) / ((hit[~is_bad].sum() + 1) / ((~is_bad).sum() + 2))
    texts = [[form.decode(errors="replace") for (_, form), x in zip(stems, lexicon, strict=True) if x == k] for k in range(LEXICONS)]
    return Voters(stem, lexicon[order], texts, float(np.clip(n[1] / (n[0] + n[1]), 0.01, 0.5)), ratio, group)


@dataclass
class Model:
    scorer: Scorer
    label_model: LabelModel


def fit(docs: DataFrame, voters: Voters, each: int = FITTED) -> Model | None:
    """A classifier of the label model's posteriors; no label is read here. None without any text to learn from.

    The label model sees the votes of all texts that aren't held out; the classifier is fitted on about
    `each` of either class, chosen by the hash of doc_id.
    """
    rows = docs.where("text is not null and doc_id is not null").where(crc_mod(5) != 0).select(F.pmod(F.xxhash64(doc_key()), F.lit(1 << 30)).alias("h"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    votes = lambda texts: shared.value.votes(texts)
    codes, counts = pattern_counts(rows, votes)
    if not len(codes):
        return None
    patterns = decode(codes, LEXICONS + len(_PATTERNS))
    model = fit_label_model(patterns, counts, prior=voters.prior, start=voters.ratio, groups=voters.group)
    toxic = counts[posteriors(patterns, model) >= 0.5].sum()
    rates = tuple(min(1.0, each / max(n, 1)) for n in (counts.sum() - toxic, toxic))
    return Model(fit_scorer(sampled(rows, votes, features, model, rates, 4 * each), 1 << BITS, rounds=160, lasso=LASSO, positive=True), model)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5).

    The model learns from rows whose crc32(doc_id as text) mod 5 is not 0; held_out marks the
    others. A document with several labels counts as toxic if one of them says so. A null or empty text
    has the score of a text without features; every score is 0 where labels don't hold both classes. A
    null doc_id counts as the empty text and isn't learned from. Repeated rows, an empty table and
    further columns need no care.
    """
    voters = mine(docs, labels)
    model = fit(docs, voters) if voters else None
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer if model else None)

    def run(batch: pa.RecordBatch):
        n = batch.num_rows
        score = np.zeros(n)
        if shared.value is not None:
            rows, buckets, _ = features(text_of(batch))
            score = shared.value.probability(rows, buckets, None, n)
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
