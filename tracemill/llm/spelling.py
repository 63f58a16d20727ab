"""Spelling variants of a corpus's words by full neighbourhood generation.

For every word of the vocabulary, all distinct strings that one deletion, replacement or insertion over the observed alphabet makes
are generated, and joined by hash to the vocabulary: what is found is near, without any distance being computed. Distinct by rule:
of a run of equal letters only the first is deleted, and a letter is inserted only where it doesn't follow an equal one.

A neighbour's 64-bit hash follows from the word's prefix sums in constant time. Only neighbours whose hash is set in a bit field of
the vocabulary's hashes, of bounded size, become strings and are shuffled; the join on strings decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed
from .kernels import LOWER, entered, raw, released, slices, text_of, words

#: Code points of a word, its occurrences, and how many times as frequent its form has to be.
LENGTH, OCCURRENCES, FACTOR = 7, 2, 10
#: Of the runs, those whose hash this divides lose a letter.
SLIP = 31
#: Bits of the field by word, and bits at most (16 MiB); a fuller field lets more neighbours through to the join.
BITS_A_WORD, BITS = 64, 1 << 27
#: Neighbours that are hashed at once.
CHUNK = 1 << 20
#: The form of a word has FACTOR times its n, a long: so many steps at most, and so many doublings.
DOUBLINGS = 5

_U = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_MIXED = np.random.default_rng(12).integers(0, 1 << 64, 1 << 12, dtype=np.uint64)


def _signs() -> np.ndarray:
    out = np.ones(256, bool)
    out[[*range(65, 91), *range(97, 123)]] = False
    return out


_OTHER = _signs()


def runs_of(texts: pa.Array, least: int = 1) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of A-Z, a-z and U+00C0 to U+00FF of at least so many bytes, A-Z lower-cased, and the row of each."""
    data, offs = raw(texts)
    part = ~_OTHER[data] | (data == 0xC3)  # in UTF-8, U+00C0 to U+00FF are the byte 0xC3 and one more
    part[1:] |= data[:-1] == 0xC3
    start, end, row = words(part.view(np.uint8), offs, _UNSET)
    keep = end - start >= least
    start, end, row = start[keep], end[keep], row[keep]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    held = LOWER[data][np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)), pa.py_buffer(held)), row


_UNSET = np.arange(256) == 0


class Crc:
    """CRC-32 of a prefix and a word from their own ones: the prefix's is shifted by the word's zero bytes, a linear map of 32 bits."""

    def __init__(self) -> None:
        self.maps: dict[int, np.ndarray] = {}

    def shift(self, size: int) -> np.ndarray:
        """The map for `size` zero bytes as four tables by byte."""
        if size not in self.maps:
            if len(self.maps) > 1024:
                self.maps.clear()
            zero, empty = bytes(size), zlib.crc32(bytes(size))
            bit = np.array([zlib.crc32(zero, 1 << k) ^ empty for k in range(32)], np.uint32).reshape(4, 8)
            tables = np.zeros((4, 256), np.uint32)
            for k in range(8):
                tables[:, np.arange(256) >> k & 1 == 1] ^= bit[:, k : k + 1]
            self.maps[size] = tables
        return self.maps[size]

    def join(self, prefix: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(prefix), np.uint32)
        order = np.argsort(size, kind="stable")
        edges = np.flatnonzero(np.diff(size[order], prepend=-1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
            of = order[lo:hi]
            p, t = prefix[of], self.shift(int(size[of[0]]))
            out[of] = t[0, p & 255] ^ t[1, p >> 8 & 255] ^ t[2, p >> 16 & 255] ^ t[3, p >> 24] ^ word[of]
        return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of at least LENGTH code points that occur OCCURRENCES times, after slips.

    Runs are those of whole texts (null: none; a null doc_id counts as the empty text); the hash of a run is the CRC-32 of
    `<doc_id>:<run>`, so a document's equal runs slip alike. Words are counted by slice and then summed by Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        crc = Crc()
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                found, row = runs_of(text_of(part), LENGTH)
                coded = found.dictionary_encode()
                letters = coded.dictionary.to_pylist()
                which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key, times = np.unique(row * np.int64(len(letters) + 1) + which, return_counts=True)
                row, which = key // (len(letters) + 1), key % (len(letters) + 1)
                prefix = np.array([zlib.crc32(f"{x}:".encode()) for x in part.column(0).to_pylist()], np.uint32)
                spelled = [w.encode() for w in letters]
                own = np.fromiter(map(zlib.crc32, spelled), np.uint32, len(letters))
                size = np.fromiter(map(len, spelled), np.int64, len(letters))
                h = crc.join(prefix[row], own[which], size[which])
                slipped = h % SLIP == 0
                counts = np.bincount(which[~slipped], times[~slipped], len(letters)).astype(np.int64)
                out: dict[str, int] = {}
                for w, hash_, n in zip(which[slipped].tolist(), h[slipped].tolist(), times[slipped].tolist()):
                    word = letters[w]
                    at = hash_ % len(word)
                    word = word[:at] + word[at + 1 :]
                    out[word] = out.get(word, 0) + n
                at = np.flatnonzero(counts)
                spoken = [letters[k] for k in at] + list(out)
                number = counts[at].tolist() + list(out.values())
                long = [len(w) >= LENGTH for w in spoken]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, x in zip(spoken, long) if x], pa.string()), pa.array([n for n, x in zip(number, long) if x], pa.int64())], ["word", "n"])
            released()

    counted = docs.selectExpr("coalesce(cast(doc_id as string), '') doc_id", "cast(text as string) text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Words:
    """The neighbours of words of one length as numbers: hashes first, strings for the few that are asked for.

    A string's hash is the sum of T[letter] * R**place.
    """

    def __init__(self, spelled: list[str]) -> None:
        self.spelled = spelled
        m, n = len(spelled), len(spelled[0])
        self.codes = np.frombuffer("".join(spelled).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(m, n)
        self.power = np.cumprod(np.concatenate([[_U(1)], np.full(n + 1, _R, _U)]), dtype=_U)
        self.sums = np.zeros((m, n + 1), _U)
        np.cumsum(_MIXED[self.codes % len(_MIXED)] * self.power[:n], axis=1, dtype=_U, out=self.sums[:, 1:])

    def hashes(self) -> np.ndarray:
        return self.sums[:, -1]

    def near(self, alphabet: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, str]]:
        """Of all distinct neighbours those that may be held in a bit field: the word's number and the string."""
        (m, n), c, s, p = self.codes.shape, self.codes, self.sums, self.power
        after = s[:, -1:] - s  # sum from each place on
        first = np.ones((m, n), bool)
        first[:, 1:] = c[:, 1:] != c[:, :-1]
        k, at = np.nonzero(first & _held(held, s[:, :-1] + after[:, 1:] * _U(_RINV)))
        for x, i in zip(k.tolist(), at.tolist()):
            w = self.spelled[x]
            yield x, w[:i] + w[i + 1 :]
        t, letters = _MIXED[alphabet % len(_MIXED)], list(map(chr, alphabet.tolist()))
        before = np.concatenate([np.full((m, 1), -1), c], axis=1)
        step = max(1, CHUNK // (m * max(1, len(alphabet))))
        for kept, base, other in ((1, s[:, :-1] + after[:, 1:], c), (0, s + after * _U(_R), before)):  # replacements, insertions
            for lo in range(0, base.shape[1], step):
                hi = lo + step
                h = base[:, lo:hi, None] + (t[None, :] * p[lo : min(hi, base.shape[1]), None])[None]
                k, at, letter = np.nonzero(_held(held, h))
                fit = other[k, lo + at] != alphabet[letter]
                for x, i, q in zip(k[fit].tolist(), (lo + at[fit]).tolist(), letter[fit].tolist()):
                    w = self.spelled[x]
                    yield x, w[:i] + letters[q] + w[i + kept :]


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a field of a power of two of bits."""
    return h >> _U(65 - bits.bit_length()), h >> _U(8) & _U(bits - 1)


def _held(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both places of a hash are set in a field of bytes."""
    flat = h.ravel()
    a, b = _probes(flat, len(field) << 3)
    out = (field[a >> _U(3)] >> (a & _U(7)).astype(np.uint8) & 1).view(bool)
    on = np.flatnonzero(out)
    b = b[on]
    out[on] = (field[b >> _U(3)] >> (b & _U(7)).astype(np.uint8) & 1).view(bool)
    return out.reshape(h.shape)


def _by_length(spelled: list[str]) -> Iterator[list[int]]:
    """Numbers of the words of each length, in bounded groups."""
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1))
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        step = max(1, CHUNK // (64 * int(size[order[lo]]) + 64))
        for k in range(lo, hi, step):
            yield order[k : min(hi, k + step)].tolist()


def field(vocabulary: DataFrame, n: int) -> np.ndarray:
    """The bit field of the hashes of a vocabulary of n words, as bytes; set by tasks, merged by Spark, BITS at most."""
    bits = 1 << max(16, min(BITS.bit_length() - 1, (n * BITS_A_WORD).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(0).to_pylist()
            hashes = [Words([spelled[k] for k in of]).hashes() for of in _by_length(spelled)]
            place = np.unique(np.concatenate([x.astype(np.int64) for h in hashes for x in _probes(h, bits)])) if hashes else np.zeros(0, np.int64)
            if len(place):
                first = np.flatnonzero(np.diff(place >> 5, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(place[first] >> 5), pa.array(np.bitwise_or.reduceat(np.int64(1) << (place & 31), first))], ["place", "bits"])

    set_ = vocabulary.select("word").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = set_.select(F.col("place").cast("int"), F.col("bits")).toArrow()
    out = np.zeros(bits >> 5, "<u4")
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype("<u4")
    return out.view(np.uint8)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words of the vocabulary (word, n) that one deletion, replacement or insertion makes of each other, each both ways."""
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").distinct()  # 90 at most: a-z and U+00C0 to U+00FF
    alphabet = np.array(sorted(ord(r.letter) for r in letters.collect()), np.int64)
    total = vocabulary.count()
    bits = field(vocabulary, total)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        held = shared.value
        for batch in batches:
            spelled, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for of in _by_length(spelled):
                found = list(Words([spelled[k] for k in of]).near(alphabet, held))
                if found:
                    number = [of[k] for k, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array([spelled[k] for k in number]), pa.array([n[k] for k in number], pa.int64()), pa.array([x for _, x in found])], ["word", "n", "near"])

    # words are dealt out by their hash: a task's work is a share of all words, of any length
    dealt = vocabulary.repartition(max(1, min(2_000, total // 2_000)), "word") if total > 2_000 else vocabulary
    candidates = dealt.select("word", "n").mapInArrow(run, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words and their n are those of `count_words`. form is the near word of largest n, of equal ones the smallest in code-point order,
    if its n is at least FACTOR times the word's, else null, as form_n is then; root is the end of the chain of forms, the word itself
    without a form. A null or empty text has no words, repeated rows count again, an empty table gives no rows, other columns are
    not read.
    """
    vocabulary = checkpointed(count_words(docs))
    # the least of (-n, word) is the largest n and, of equal ones, the smallest word
    best = neighbours(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    chosen = (
        vocabulary.join(best, "word", "left")
        .withColumn("good", -F.col("best.less") >= FACTOR * F.col("n"))
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("good"), F.col("best.near")).alias("form"), F.when(F.col("good"), -F.col("best.less")).alias("form_n"))
    )
    chosen = checkpointed(chosen)
    step = chosen.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return chosen.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
