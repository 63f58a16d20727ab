"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its affixes and inner character n-grams (hashed 3- and 4-byte grams with word
boundaries) and, for words of the lexicon, the word itself. Weights and transitions are learned by
maximising the conditional likelihood of code-switched sequences, made of runs of words from
labelled texts of different languages. Forward-backward labels every word of a text; the language
with the largest sum of word posteriors is the text's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import Sums, crc_mod, doc_key, map_batches, raw, slices, text_of, words

BITS = 17
#: Characters of the labelled texts that the model is fitted on, about, shared out evenly to the languages; with more than
#: WIDE languages they are fewer, as every word then costs more. Texts are whole: a language is learned from one at least.
SAMPLE_CHARS, WIDE = 1_500_000, 16
#: Words times languages that are labelled at once.
CELLS = 1 << 21
#: Languages up to which the table of their rates is broadcast; beyond that it is joined by shuffle.
BROADCAST = 10_000
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    index: list[np.ndarray]  # for 3-grams and 4-grams: the table's row of each of 2**BITS buckets; the last row, of zeros, for buckets not seen
    grams: list[np.ndarray]  # their tables
    lexicon: np.ndarray  # hashes of the words that are features themselves, sorted
    whole: np.ndarray  # their weights
    move: np.ndarray  # transition scores


@dataclass
class _Words:
    """The words of a slice: their row and hash, and the gram buckets of their letters."""

    row: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    three: np.ndarray
    four: np.ndarray
    inner: np.ndarray
    length: np.ndarray


def _cut(texts: pa.Array) -> _Words:
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    data, offs = raw(pc.binary_join_element_wise(" ", letters, " ", ""))
    start, end, row = words(data, offs)
    if not len(start):
        z = np.zeros(0, np.int64)
        return _Words(z, z.astype(np.uint64), z, z, z, z.astype(bool), z)
    sums = Sums(data)
    length = end - start
    begin = np.cumsum(length) - length
    at = np.repeat(start - begin, length) + np.arange(length.sum())
    inner = np.ones(len(at), bool)
    inner[begin + length - 1] = False
    four = np.zeros(len(at), np.int64)
    four[inner] = sums.buckets(4, BITS)[at[inner] - 1]
    return _Words(row, sums.ranges(start, end), begin, sums.buckets(3, BITS)[at - 1], four, inner, length)


def _lexical(hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are in the lexicon, and their rows in it."""
    if not len(lexicon):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    at = np.flatnonzero(lexicon[k] == hashes)
    return at, k[at]


def _emissions(w: _Words, m: Model) -> np.ndarray:
    each = m.grams[0][m.index[0][w.three]]
    each[w.inner] += m.grams[1][m.index[1][w.four[w.inner]]]
    out = np.add.reduceat(each, w.begin, axis=0).astype(np.float64)
    at, k = _lexical(w.hash, m.lexicon)
    out[at] += m.whole[k]
    return out


def marginals(scores: np.ndarray, counts: np.ndarray, move: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of every word of many sequences, and scaled forward and backward messages.

    scores: emission scores of all words, sequence after sequence; counts: words of each. Sequences
    are cut to blocks. All blocks advance together, first to get each block's transfer matrix, then,
    with the messages that enter it, to get the messages of its words. This is exact. With many labels,
    whose matrices would be large, a sequence is one block and needs none.
    """
    n, k = scores.shape
    counts = counts[counts > 0]
    block = block if k <= WIDE else int(counts.max())
    psi = np.exp(scores - scores.max(1, keepdims=True))
    trans = np.exp(move)
    blocks = -(-counts // block)
    total = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    rank = np.arange(total) - np.repeat(first, blocks)
    start = np.repeat(np.cumsum(counts) - counts, blocks) + rank * block
    size = np.minimum(np.repeat(np.cumsum(counts), blocks) - start, block)
    idx = np.minimum(start[:, None] + np.arange(block), n - 1)
    live = np.arange(block) < size[:, None]
    matrix = np.tile(np.eye(k), (total, 1, 1)) if total > len(counts) else None
    for j in range(min(block, int(size.max())) if matrix is not None else 0):
        now = (matrix.reshape(-1, k) @ trans).reshape(total, k, k) * psi[idx[:, j]][:, None, :]
        now /= now.max((1, 2), keepdims=True)
        matrix = np.where(live[:, j, None, None], now, matrix)
    enter, leave = np.full((total, k), 1 / k), np.ones((total, k))
    by_rank = np.split(np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank))[:-1])
    for later in by_rank[1:]:
        a = np.einsum("bi,bij->bj", enter[later - 1], matrix[later - 1])
        enter[later] = a / a.sum(1, keepdims=True)
    for later in by_rank[:0:-1]:
        b = np.einsum("bij,bj->bi", matrix[later], leave[later])
        leave[later - 1] = b / b.sum(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a, b = enter, leave
    for j in range(min(block, int(size.max()))):
        on = live[:, j]
        now = (a[on] @ trans) * psi[idx[on, j]]
        now /= now.sum(1, keepdims=True)
        a[on] = alpha[idx[on, j]] = now
    for j in range(min(block, int(size.max())) - 1, -1, -1):
        on = live[:, j]
        beta[idx[on, j]] = b[on]
        now = (psi[idx[on, j]] * b[on]) @ trans.T
        b[on] = now / now.sum(1, keepdims=True)
    both = alpha * beta
    return both / both.sum(1, keepdims=True), alpha, psi * beta


def fit(texts: list[str], labels: list[str], seed: int = 7, rounds: int = 30, run: int = 32) -> Model | None:
    """A model from a bounded sample of labelled texts; None if none of them has a letter."""
    langs = sorted(set(labels))
    k = len(langs)
    w = _cut(pa.array(texts, pa.string()))
    if not len(w.row):
        return None
    gold_of_row = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    # Runs of 3 to 12 words of one text, in random order, make code-switched sequences.
    n = len(w.row)
    cut = np.zeros(n, bool)
    cut[np.cumsum(rng.integers(3, 13, n // 3 + 1))[:, None].ravel() % max(n, 1)] = True
    cut[np.flatnonzero(np.diff(w.row, prepend=-1))] = True
    piece = np.cumsum(cut) - 1
    order = np.argsort(rng.permutation(int(piece[-1]) + 1)[piece], kind="stable") if n else np.zeros(0, np.int64)
    counts = np.full(-(-n // run), run)
    counts[-1:] = n - run * (len(counts) - 1)
    gold = gold_of_row[w.row]
    value, at, times = np.unique(w.hash, return_index=True, return_counts=True)
    lexicon = value[times >= 3]
    word_at, word_k = _lexical(w.hash, lexicon)
    seen = [np.unique(x, return_inverse=True) for x in (w.three, w.four[w.inner])]
    index = [np.full(1 << BITS, len(x), np.int32) for x, _ in seen]
    for to, (x, _) in zip(index, seen, strict=True):
        to[x] = np.arange(len(x))
    m = Model(langs, index, [np.zeros((len(x) + 1, k), np.float32) for x, _ in seen], lexicon, np.zeros((len(lexicon), k)), np.zeros((k, k)))
    owner = np.repeat(np.arange(n), w.length)
    squares = [np.full(x.shape, 1e-6) for x in (m.grams[0], m.grams[1], m.whole, m.move)]
    onehot = np.eye(k)[gold]
    head = np.zeros(n, bool)
    head[np.cumsum(counts) - counts] = True
    pair = np.zeros((k, k))
    g = gold[order]
    np.add.at(pair, (g[:-1][~head[1:]], g[1:][~head[1:]]), 1)
    for _ in range(rounds):
        post, alpha, back = marginals(_emissions(w, m)[order], counts, m.move)
        grad = np.empty((n, k))
        grad[order] = post
        grad = onehot - grad
        two = alpha[:-1][~head[1:], :, None] * np.exp(m.move) * back[1:][~head[1:], None, :]
        expected = (two / two.sum((1, 2), keepdims=True)).sum(0)
        steps = [
            np.stack([np.bincount(seen[0][1], grad[owner, c], len(m.grams[0])) for c in range(k)], 1),
            np.stack([np.bincount(seen[1][1], grad[owner[w.inner], c], len(m.grams[1])) for c in range(k)], 1),
            np.stack([np.bincount(word_k, grad[word_at, c], len(lexicon)) for c in range(k)], 1) if len(lexicon) else np.zeros((0, k)),
            pair - expected,
        ]
        for x, s, step in zip((m.grams[0], m.grams[1], m.whole, m.move), squares, steps, strict=True):
            step = step - 0.02 * x
            s += step**2
            x += (0.25 * step / np.sqrt(s)).astype(x.dtype)
    return m


def learn(docs: DataFrame, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model of all values of lang, fitted on labelled rows that aren't held out; None without any letter.

    A language's rows are taken whole, in the order of a hash, while they fit into its share of `chars`;
    a row longer than that is taken only where a language has no shorter one.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), crc_mod(4).alias("m"), F.xxhash64(doc_key(), "text").alias("h"))
    rows = rows.where("m <> 2 and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    size = F.floor(F.log2(F.length("text").cast("double"))).cast("int")
    sizes = rows.groupBy("lang", size.alias("size")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    known = sorted({r["lang"] for r in sizes})
    if not known:
        return None
    share = int(chars * min(1.0, WIDE / len(known))) // len(known)
    rates = []
    for lang in known:
        own = [r for r in sizes if r["lang"] == lang]
        top = max(share.bit_length() - 2, min(r["size"] for r in own))  # the lengths of 2**size to 2**(size + 1) that fit
        n, total = (sum(r[c] for r in own if r["size"] <= top) for c in ("n", "chars"))
        rates.append((lang, top, 1.0 if n <= 50 else min(1.0, 4 * share / total + 30 / n)))  # rows of about four shares, so that one is filled
    table = docs.sparkSession.createDataFrame(rates, "lang string, top int, rate double")
    some = rows.join(F.broadcast(table) if len(rates) <= BROADCAST else table, "lang").where((size <= F.col("top")) & (F.pmod(F.col("h"), F.lit(1 << 20)) + 0.0 < F.col("rate") * (1 << 20)))
    order = Window.partitionBy("lang").orderBy("h", "text")
    ahead = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the first row stays whatever its length
    taken = some.withColumns({"ahead": ahead, "nth": F.row_number().over(order)}).where((F.col("ahead") <= share) | (F.col("nth") == 1))
    pairs = sorted((r["lang"], r["h"], r["text"]) for r in taken.select("lang", "h", "text").collect())
    return fit([t for _, _, t in pairs], [k for k, _, _ in pairs]) if pairs else None


def label_words(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and language posteriors of every word."""
    w = _cut(texts)
    if not len(w.row):
        return w.row, np.zeros((0, len(model.langs)))
    return w.row, marginals(_emissions(w, model), np.bincount(w.row, minlength=len(texts)), model.move)[0]


def identify_documents(docs: DataFrame, chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words, n_switches.

    The model learns from rows whose crc32(doc_id as text) mod 4 is not 2; held_out marks the others.
    lang_pred is `und`, with score 0, for a null text, a text without letters, and every text if no
    labelled row with a letter is there to learn from. score is the mean posterior of lang_pred over the text's
    words; n_switches counts neighbouring words with different likeliest languages. A null doc_id
    counts as the empty text; repeated rows, an empty table and further columns need no care. Equal
    sums go to the language first in the alphabet.
    """
    model = learn(docs, chars)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(whole: pa.RecordBatch):
        m = shared.value
        least = CELLS if m is None else max(1, 6 * CELLS // len(m.langs))  # bytes of text
        for batch in slices(whole, limit=least):
            yield label(batch, m)

    def label(batch: pa.RecordBatch, m: Model | None) -> dict:
        texts, n = text_of(batch), batch.num_rows
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        count, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if m is not None:
            row, post = label_words(m, texts)
            count = np.bincount(row, minlength=n)
            total = np.stack([np.bincount(row, post[:, c], n) for c in range(len(m.langs))], 1)
            some = count > 0
            best = total.argmax(1)
            lang[some] = np.array(m.langs, object)[best[some]]
            score[some] = np.clip(total[np.arange(n), best][some] / count[some], 0, 1)
            word = post.argmax(1)
            moved = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] != word[:-1]))
            switches = np.bincount(row[moved], minlength=n)
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score), "n_words": pa.array(count, pa.int64()), "n_switches": pa.array(switches, pa.int64())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")
