"""BPE encoding and decoding: merges found through a segment tree over the ranks of adjacent pairs.

The vocabulary file holds a "tokenizers" JSON model (its path is a parameter). A pre-token's symbols
form a doubly linked list; leaf i of a segment tree holds the rank of the pair that begins at symbol
i, inner nodes the least (rank, place), so the root is the leftmost pair of lowest rank. A merge
rewrites at most three leaves, each in logarithmic time, until the root holds no mergeable pair.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import holds, map_batches, text_of

_NONE = 1 << 62
#: Pre-tokens whose pieces a Python worker remembers; the memory starts anew when it is full.
MEMORY = 250_000


def default_vocabulary() -> str:
    """The path of the public word-level vocabulary that is installed beside the engine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Symbols after all merges; pairs: (left, right) -> (rank, merged symbol)."""
    n = len(ids)
    if n < 2:
        return ids
    ids = list(ids)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if found := pairs.get((ids[i], ids[i + 1])):
            tree[size + i] = found[0] << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1

    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        ids[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, _NONE)
        if k < n:
            before[k] = i
            found = pairs.get((ids[i], ids[k]))
            put(i, found[0] << 32 | i if found else _NONE)
        else:
            put(i, _NONE)
        if (p := before[i]) >= 0:
            found = pairs.get((ids[p], ids[i]))
            put(p, found[0] << 32 | p if found else _NONE)
    return [x for x in ids if x >= 0]


class Codec:
    """One vocabulary, loaded once in each Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.letter = {b: vocab[letters[b]] for b in range(256)}
        self.final = {b: vocab[letters[b] + self.suffix] for b in range(256)}
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) and x["content"].startswith("<|") for x in spec["added_tokens"])
        assert plain, "added tokens that are cut in another way"
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        steps = spec["normalizer"]["normalizers"]
        assert [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and spec.get("decoder") is None, "another kind of vocabulary"
        self.space = regex.compile(steps[1]["pattern"]["Regex"])
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.memory: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.spelled = {letters[b]: b for b in range(256)}
        #: Letters whose class and case are the same in every Unicode version; other texts are cut by the library itself.
        self.settled = regex.compile("[\\x00-\\u0233\\u2010-\\u2027]*+")

    def piece(self, word: str, b: bytes | None = None) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        b = word.encode() if b is None else b
        ids = [self.letter[x] for x in b[:-1]] + [self.final[b[-1]]]
        out = array("I", merge(ids, self.pairs)).tobytes()
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        if len(word) < 64:
            self.memory[word] = out
        return out

    def normal(self, text: str) -> str:
        """NFC, runs of white space as one space, lower case letter by letter."""
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return self.space.sub(" ", text).lower()

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        if self.splits is not None and "<|" in text:
            for m in self.splits.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(array("I", [self.special[m[0]]]).tobytes())
                at = m.end()
        out += self._plain(text[at:] if at else text)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        if not text:
            return []
        get, piece = self.memory.get, self.piece
        if not self.settled.fullmatch(text):
            found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            spelled = [bytes(map(self.spelled.__getitem__, w)) for w, _ in found]
            return [get(w := b.decode("utf-8", "surrogateescape")) or piece(w, b) for b in spelled]
        return [get(w) or piece(w) for w in self.word.findall(self.normal(text))]

    def decode(self, ids: array) -> str:
        """Without a decoder in the vocabulary, tokens are joined by single spaces."""
        return " ".join(map(self.token.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    holds(__name__, codec.cache_clear)
    return Codec(path)


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids and decoded with keep_ids).

    ids_sha256 digests the ids as little-endian unsigned 32-bit integers, decoded_sha256 the UTF-8
    bytes of the decoded text. A null or empty text has no tokens and an empty decoding. Rows are
    independent: repeated rows, a null doc_id and an empty table pass through, other columns are not
    read. Texts of any length are encoded whole, one pre-token at a time.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids

    def run(batch: pa.RecordBatch):
        c = codec(path)
        cols: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in text_of(batch).to_pylist():
            packed = c.encode(text)
            ids = array("I")
            ids.frombytes(packed)
            decoded = c.decode(ids)
            cols["n_tokens"].append(len(ids))
            cols["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            cols["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if keep_ids:
                cols["ids"].append(list(ids))
                cols["decoded"].append(decoded)
        out = {"doc_id": batch.column(0), "n_tokens": pa.array(cols["n_tokens"], pa.int64()), "ids_sha256": pa.array(cols["ids_sha256"], pa.string()), "decoded_sha256": pa.array(cols["decoded_sha256"], pa.string())}
        if keep_ids:
            out |= {"ids": pa.array(cols["ids"], pa.list_(pa.int64())), "decoded": pa.array(cols["decoded"], pa.string())}
        yield out

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)
