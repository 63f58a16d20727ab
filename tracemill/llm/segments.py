"""Tokens of whole texts through their distinct segments.

A text is cut where no token of a vocabulary can lie across: before a space, line feed or tab that follows a visible character, and
before one of ``. , ; : ! ?`` that follows a letter. Segments repeat, so each distinct one of a slice is encoded once by the
vocabulary's own library and remembered; the tokens of a text are those of its segments in order. `byte_level` and `pieces` check
that a vocabulary allows these cuts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .kernels import holds, raw

#: Distinct segments, and their bytes, that a Python worker remembers; the memory starts anew when it is full.
MEMORY, MEMORY_BYTES = 600_000, 16 << 20
#: Bytes of text that are cut into segments at once; a longer single text is handled alone.
SLICE = 8 << 20

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b" \n\t"]] = 1
_CLASS[[*b".,;:!?"]] = 2
_SEEN = np.zeros(256, bool)
_SEEN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of white space, and of characters from U+0240 on, whose class may depend on the Unicode version.
_ODD = np.zeros(256, bool)
_ODD[[*b" \n\t\r\x0b\x0c", *range(0xC9, 256)]] = True


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where segments begin, and the length of the data at the end; texts end segments, empty texts have none."""
    if not len(data):
        return np.zeros(1, np.int64)
    at = 1 + np.flatnonzero(_CLASS[data[1:]])
    kind, before = _CLASS[data[at]], data[at - 1]
    accented = (at > 1) & (data[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)  # U+00C0 to U+00FF but for the two signs among them
    at = at[((kind == 1) & _SEEN[before]) | ((kind == 2) & _LETTER[before]) | accented]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    cut[offs] = True
    return np.flatnonzero(cut)


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For every segment the place of its text among the distinct ones, and those."""
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


class Ragged:
    """Runs of values, appended in bulk."""

    def __init__(self, kind: type) -> None:
        self.values, self.ends = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values = np.concatenate([self.values, np.asarray(values, self.values.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def counts(self, runs: np.ndarray) -> np.ndarray:
        return self.ends[runs + 1] - self.ends[runs]

    def take(self, runs: np.ndarray) -> np.ndarray:
        """The values of the runs, one after the other."""
        return self.values[spread(self.ends[runs], self.counts(runs))]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] places, for each i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Memory:
    """Facts about segments: `encode` gives, for a list of segments (`turn` at once at most), named runs of values (values, counts); `most` segments are remembered."""

    def __init__(self, encode: Callable[[list[bytes]], dict[str, tuple[np.ndarray, np.ndarray]]], kinds: dict[str, type], most: int = MEMORY, turn: int = 1 << 62) -> None:
        self.encode, self.kinds, self.most, self.turn = encode, kinds, most, turn
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.runs = {k: Ragged(v) for k, v in self.kinds.items()}

    def places(self, segments: list[bytes]) -> np.ndarray:
        """The run of each segment; runs of earlier calls stay valid until the next call only."""
        if len(self.at) > self.most or self.bytes > MEMORY_BYTES:
            self.clear()
        at = self.at
        found = list(map(at.get, segments))
        if None in found:
            new = [s for s, run in zip(segments, found) if run is None]
            for k in range(0, len(new), self.turn):
                some = new[k : k + self.turn]
                for name, (values, counts) in self.encode(some).items():
                    self.runs[name].add(values, counts)
                at.update(zip(some, range(len(at), len(at) + len(some))))
            self.bytes += sum(map(len, new))
            found = list(map(at.__getitem__, segments))
        return np.array(found, np.int64)


def flat(runs: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of lists."""
    counts = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter(itertools.chain.from_iterable(runs), np.int64, int(counts.sum())), counts


def of_texts(texts: pa.Array, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """The run of each segment of the texts in order, and the text it belongs to."""
    data, offs = raw(texts)
    bounds = cuts(data, offs)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, segments = distinct(data, bounds)
    return memory.places(segments)[which], np.searchsorted(offs, bounds[:-1], "right") - 1


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    from .kernels import slices

    yield from slices(batch, column, limit)


class ByteLevel:
    """Encodes segments by a byte-level vocabulary ("tokenizers" JSON).

    Characters whose class may depend on the Unicode version, and special strings, are left to the tokenizers library; the rest goes
    through tiktoken with the same vocabulary, which is several times as fast and gives the same ids.
    """

    def __init__(self, path: str, special: bool) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added, model = spec["pre_tokenizer"], spec["added_tokens"], spec["model"]
        plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or set(x["content"]) & set(" \n\t.,;:!?")) for x in added)
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or not plain or model.get("ignore_merges"):
            raise ValueError("another kind of vocabulary: its tokens may lie across the cuts of segments")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        letter = {c: b for b, c in enumerate(byte_letters())}
        special_ids = {x["id"] for x in added}
        self.bytes = [b""] * (1 + max(model["vocab"].values()))
        for token, i in model["vocab"].items():
            if i not in special_ids:
                self.bytes[i] = bytes(map(letter.__getitem__, token))
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        # tiktoken merges the pair whose merged token has the least id; that is the file's order only if ids follow the merges
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(set(merged)) and len(merged) + 256 == len(model["vocab"]) - sum(x["content"] in model["vocab"] for x in added):
            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: that of byte-level vocabularies of this kind
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.apart = self.bytes.index(b"\n")
        self.special = special and bool(added)

    def __call__(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by segment.

        A segment without white space but for one leading space, and of settled characters, is encoded alike alone and between
        line feeds, which no token joins with it: all of those go through one call.
        """
        blob = np.frombuffer(b"\n".join(segments), np.uint8)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        begin = np.cumsum(size + 1) - size - 1
        odd = _ODD[blob]
        odd[begin[size > 0]] &= blob[begin[size > 0]] != 0x20
        odd[1:] |= (blob[:-1] == 0xC2) & ((blob[1:] == 0x85) | (blob[1:] == 0xA0))
        if self.special:
            odd |= blob == ord("<")
        odd[begin[1:] - 1] = False
        plain = np.add.reduceat(odd, begin, dtype=np.int64) == 0 if self.fast is not None else np.zeros(len(segments), bool)
        first, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        out = Ragged(np.int64)
        if len(first):
            ids = np.array(self.fast(b"\n".join([segments[i] for i in first]).decode()), np.int64)
            ends = np.append(np.flatnonzero(ids == self.apart), len(ids))
            out.add(ids[ids != self.apart], np.diff(ends, prepend=-1) - 1)
        if len(rest):
            out.add(*flat([e.ids for e in self.library.encode_batch_fast([segments[i].decode() for i in rest], add_special_tokens=False)]))
        place = np.empty(len(segments), np.int64)
        place[first], place[rest] = np.arange(len(first)), len(first) + np.arange(len(rest))
        return out.take(place), out.counts(place)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b if b in plain else next(others)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def byte_level(path: str, special: bool) -> ByteLevel:
    """special: whether the vocabulary's special strings in texts are tokens of their own, not plain text."""
    holds(__name__, _forget)
    return ByteLevel(path, special)


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """The library's encoder of a piece vocabulary."""
    holds(__name__, _forget)
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=path)
    for i in range(found.vocab_size()):
        p = found.id_to_piece(i)
        if not (found.is_byte(i) or found.is_control(i) or found.is_unknown(i)):
            crosses = any(y in " \n\t" or (y == "▁" and x != y) or (y in ".,;:!?" and x.isalpha()) for x, y in zip(p, p[1:]))
            if crosses or p[:1] in ("\n", "\t", " "):
                raise ValueError(f"another kind of vocabulary: {p!r} may lie across the cuts of segments")
    return found


def _forget() -> None:
    byte_level.cache_clear()
    pieces.cache_clear()
