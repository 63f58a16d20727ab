"""Benchmark passages inside documents, exact or edited: q-gram lemma filtering and banded alignment.

A passage of m bytes (UTF-8) that occurs with at most k edits shares at least m + 1 - q (k + 1) of its
q-grams with the place where it occurs, on diagonals (place in the text minus place in the passage)
at most k apart. Shared q-grams are counted in overlapping bands of diagonals, twice k + 1 wide and
k + 1 apart; bands that reach the bound are verified by an alignment inside the band. Texts and
passages are compared in lower case, with every run of characters other than letters and digits as
one space.

Where the bound of a short passage would ask for few q-grams or none, its q-grams are half as long, so
that every passage has its whole edit budget. A passage of fewer than q bytes has no q-gram and no edits;
it is found where it stands exactly, as whole words.

The passages are the stated query set: they are taken in blocks of bounded size, one after the other.
Each block is indexed, broadcast, held against all documents, and freed once its finds are written.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed, small
from .kernels import Sums, map_batches, raw, slices, text_of

Q = 12
#: Edits for each byte of a passage in UTF-8; insertions, deletions and changes of a byte count one each.
RATE = 0.06
#: Shared q-grams that a passage's bound has to ask for where edits are allowed; below that, its q-grams are halved.
SHARED = 4
#: Characters of the passages of one block, about.
BLOCK_CHARS = 4_000_000
#: Shared q-grams (place in a text, place in a passage) that are held at once.
ENTRIES = 1 << 21
_FILTER_BITS = 23

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes and row offsets, each byte's place in the lower-cased bytes, and those bytes."""
    data, offs = raw(pc.utf8_lower(texts))
    gap = _SEPARATOR[data]
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(data)]
    first[inner] |= gap[inner]
    keep = ~gap | first
    at = np.flatnonzero(keep)
    out = data[at].copy()
    out[gap[at]] = 32
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out, total[offs], at, data


@dataclass
class Index:
    """One block of passages and their q-grams, sorted by hash."""

    item: list[int | None]
    text: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    hash: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    filter: np.ndarray
    brief: dict[int, list[int]]  # passages of fewer than q bytes by their length
    q: int = Q
    more: tuple[Index, ...] = ()  # of the same lists, with shorter q-grams

    def halves(self) -> list[Index]:
        """The q-grams of the passages below the middle one, and the others."""
        low = self.owner < np.sort(np.unique(self.owner))[len(np.unique(self.owner)) // 2]
        return [replace(self, hash=self.hash[on], owner=self.owner[on], place=self.place[on]) for on in (low, ~low)]


def index(items: list[int | None], texts: list[str], q: int = Q, rate: float = RATE) -> Index:
    data, offs, _, _ = normal(pa.array([t or "" for t in texts], pa.string()))
    parts = [bytes(data[a:b]).strip() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    m = np.array([len(p) for p in parts], np.int64)
    edits = (rate * m).astype(np.int64)
    brief: dict[int, list[int]] = {}
    by: dict[int, list[int]] = {q: []}
    for i, p in enumerate(parts):
        if 0 < len(p) < q and not edits[i]:
            brief.setdefault(len(p), []).append(i)
        elif p:
            size = q
            while edits[i] and m[i] + 1 - size * (edits[i] + 1) < SHARED and size > 2:
                size //= 2
            by.setdefault(size, []).append(i)
    made = [_grams(list(items), parts, m, edits, own, size, brief) for size, own in by.items()]
    return replace(made[0], more=tuple(made[1:]))


def _grams(items: list, parts: list[bytes], m: np.ndarray, edits: np.ndarray, own: list[int], q: int, brief: dict) -> Index:
    grams = [Sums(np.frombuffer(parts[i], np.uint8)).grams(q) for i in own]
    h = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
    owner = np.repeat(np.array(own, np.int64), np.array([len(g) for g in grams], np.int64))
    place = np.concatenate([*map(np.arange, map(len, grams)), np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(items, parts, edits, np.maximum(m + 1 - q * (edits + 1), 1), h[order], owner[order], place[order], np.packbits(seen), brief, q)


def _costs(patterns: list[bytes], windows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern inside its window, and where that alignment ends; diagonals 0 to width - 1.

    All pairs advance together, one pattern character at a time.
    """
    c, rows = len(patterns), max(map(len, patterns))
    p = np.zeros((c, rows), np.uint8)
    t = np.zeros((c, rows + width), np.uint8)
    for i, (a, b) in enumerate(zip(patterns, windows, strict=True)):
        p[i, : len(a)] = np.frombuffer(a, np.uint8)
        t[i, : len(b)] = np.frombuffer(b, np.uint8)
    ramp = np.arange(width)
    now = np.zeros((c, width), np.int32)
    size = np.array([len(a) for a in patterns])
    best, end = np.zeros(c, np.int64), np.zeros(c, np.int64)
    far = np.full((c, 1), 1 << 20, np.int32)
    for i in range(rows):
        step = np.minimum(now + (t[:, i : i + width] != p[:, i : i + 1]), np.concatenate([now[:, 1:], far], 1) + 1)
        now = np.minimum.accumulate(step - ramp, 1) + ramp
        done = np.flatnonzero(size == i + 1)
        if len(done):
            k = now[done].argmin(1)
            best[done], end[done] = now[done, k], i + 1 + k
    return best, end


def _bands(at: np.ndarray, row: np.ndarray, grams: np.ndarray, x: Index, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, passage, band, shared q-grams) of the bands that reach their passage's bound; at, row: places of q-grams that may be shared.

    At most ENTRIES shared q-grams are held at once: rows are split first, then passages, and those of
    one passage in one row are counted part by part.
    """
    lo = np.searchsorted(x.hash, grams, "left")
    n = np.searchsorted(x.hash, grams, "right") - lo
    if n.sum() > ENTRIES and row[0] != row[-1]:
        cut = int(np.searchsorted(row, row[len(row) // 2]))
        cut = cut or int(np.searchsorted(row, row[0], "right"))
        for part in (slice(0, cut), slice(cut, None)):
            yield from _bands(at[part], row[part], grams[part], x, offs)
        return
    if n.sum() > ENTRIES and x.owner.min() != x.owner.max():
        for half in x.halves():
            yield from _bands(at, row, grams, half, offs)
        return
    at, row, lo, n = (v[n > 0] for v in (at, row, lo, n))
    if not len(at):
        return

    def entries(part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = n[part]
        entry = np.repeat(lo[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        owner = x.owner[entry]
        diagonal = np.repeat(at[part] - offs[row[part]], k) - x.place[entry]
        return np.repeat(row[part], k), owner, diagonal // (x.edits[owner] + 1)

    if n.sum() > ENTRIES:  # one passage, one row
        r, o = int(row[0]), int(x.owner[0])
        least = -(len(x.text[o]) // (int(x.edits[o]) + 1)) - 2
        count = np.zeros(int(offs[r + 1] - offs[r]) // (int(x.edits[o]) + 1) - least + 2, np.int64)
        step = max(1, ENTRIES // int(n.max()))
        for k in range(0, len(at), step):
            count += np.bincount(entries(slice(k, k + step))[2] - least, minlength=len(count))
        count[:-1] += count[1:].copy()  # a band and the next one, as below
        for b in np.flatnonzero(count >= x.bound[o]):
            yield r, o, int(b) + least, int(count[b])
        return
    rows, owner, band = entries(slice(None))
    key = np.stack([np.tile(rows, 2), np.tile(owner, 2), np.concatenate([band, band - 1])])
    key = key[:, np.lexsort(key[::-1])]
    new = np.ones(key.shape[1], bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
    first = np.flatnonzero(new)
    shared = np.diff(first, append=key.shape[1])
    good = shared >= x.bound[key[1, first]]
    yield from zip(*key[:, first[good]].tolist(), shared[good].tolist(), strict=True)


def _brief(data: np.ndarray, offs: np.ndarray, x: Index) -> Iterator[tuple[int, int, int, int]]:
    """(row, passage, start, end) of passages without a q-gram, where they stand as whole words."""
    for m, owners in x.brief.items():
        if len(data) < m:
            continue
        g = Sums(data).grams(m)
        own = Sums(np.frombuffer(b"".join(x.text[o] for o in owners), np.uint8)).grams(m)[::m]
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.isin(g, own))
        row = np.searchsorted(offs, at, "right") - 1
        ok = at + m <= offs[row + 1]
        ok &= (at == offs[row]) | (data[np.maximum(at - 1, 0)] == 32)
        ok &= (at + m == offs[row + 1]) | (data[np.minimum(at + m, len(data) - 1)] == 32)
        for a, r in zip(at[ok].tolist(), row[ok].tolist(), strict=True):
            lo, hi = (int(np.searchsorted(own[order], g[a], side)) for side in ("left", "right"))
            for k in order[lo:hi]:
                yield r, owners[k], a - int(offs[r]), a - int(offs[r]) + m


def _held(data: np.ndarray, offs: np.ndarray, x: Index, found: dict) -> None:
    """Adds the passages that bands of shared q-grams lead to."""
    todo, q = [], x.q
    if len(data) < q or not len(x.hash):
        return
    g = Sums(data).grams(q)
    top = (g >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
    maybe = np.flatnonzero((x.filter[top >> 3] >> (7 - (top & 7)).astype(np.uint8)) & 1)
    row = np.searchsorted(offs, maybe, "right") - 1
    ok = maybe + q <= offs[row + 1]
    maybe, row = maybe[ok], row[ok]
    for r, o, b, s in _bands(maybe, row, g[maybe], x, offs) if len(maybe) else ():
        k, m = int(x.edits[o]), len(x.text[o])
        left = b * (k + 1) - k
        width = 2 * (k + 1) + 2 * k + 1
        begin, stop = int(offs[r]) + left, int(offs[r]) + left + m + width
        body = bytes(max(0, offs[r] - begin)) + data[max(begin, offs[r]) : min(stop, offs[r + 1])].tobytes()
        hit = body.find(x.text[o])
        if hit >= 0:
            found.setdefault((r, o, left + hit), (left + hit + m, 0, s))
        else:
            todo.append((r, o, left, width, s, body.ljust(m + width, b"\0")))
        if len(todo) == 256:
            _verify(todo, x, found)
            todo = []
    if todo:
        _verify(todo, x, found)


def matches(texts: pa.Array, x: Index) -> list[tuple[int, int | None, int, int, int, int]]:
    """(row, item, start, end, edits, shared q-grams) of every passage found; code points of the lower-cased text."""
    data, offs, at, lower = normal(texts)
    found: dict[tuple[int, int, int], tuple[int, int, int]] = {(r, o, a): (b, 0, 0) for r, o, a, b in _brief(data, offs, x)}
    for part in (x, *x.more):
        _held(data, offs, part, found)
    if not found:
        return []
    points = np.zeros(len(lower) + 1, np.int64)
    np.cumsum((lower & 0xC0) != 0x80, out=points[1:])
    begin_of = raw(pc.utf8_lower(texts))[1]
    out = []
    for (r, o, a), (b, d, s) in sorted(found.items()):
        lo_, hi = at[offs[r] + max(a, 0)], at[min(offs[r] + b, offs[r + 1]) - 1] + 1
        base = points[begin_of[r]]
        out.append((r, x.item[o], int(points[lo_] - base), int(points[hi] - base), d, s))
    return out


def _verify(part: list[tuple], x: Index, found: dict) -> None:
    """Adds the passages that an alignment inside their band confirms."""
    width = max(w for _, _, _, w, _, _ in part)
    cost, end = _costs([x.text[o] for _, o, *_ in part], [w for *_, w in part], width)
    part = [(*c, int(d), int(e)) for c, d, e in zip(part, cost, end, strict=True) if d <= x.edits[c[1]] and e > 0]
    if part:
        _, length = _costs([x.text[o][::-1] for _, o, *_ in part], [w[:e][::-1] for *_, w, _, e in part], width)
        for (r, o, left, _, s, _, d, e), size in zip(part, length.tolist(), strict=True):
            if not any((r, o, y) in found for y in range(left + e - size - 2, left + e - size + 3)):
                found[r, o, left + e - size] = (left + e, d, s)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """The passages as indexes of bounded size."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-total // chars))
    for k in range(count if total else 0):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).distinct().orderBy("item_id", "text").collect()
        yield index([r.item_id for r in own], [r.text for r in own])


def find_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage found in a document: doc_id, item_id, start, end, edits, shared_grams.

    start and end are code points of the lower-cased text. Null and empty texts and passages, and
    passages without a letter or digit, match nothing. A passage with a null item_id is
    searched like any other and reported with that null. Null doc_ids, repeated rows, empty
    tables and further columns need no care: each row is searched by itself. Texts are searched whole.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "doc_id long, item_id long, start long, end long, edits long, shared_grams long"
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared):
            found = matches(text_of(batch), shared.value)
            if found:
                row, *rest = zip(*found, strict=True)
                yield {"doc_id": batch.column(0).take(pa.array(row))} | {n: pa.array(v, pa.int64()) for n, v in zip(("item_id", "start", "end", "edits", "shared_grams"), rest, strict=True)}

        part = checkpointed(map_batches(rows, run, schema))
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns kept, in which no passage is found.

    With one block of passages documents are filtered as they are read; with more, the digests of the
    texts with passages are gathered block by block first.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    found = blocks(benchmark)
    first, second = next(found, None), next(found, None)
    if first is None:
        return docs
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    bad = {r for r, *_ in matches(text_of(part), shared.value)}
                    yield part.filter(pa.array([r not in bad for r in range(part.num_rows)], pa.bool_())) if bad else part

        return docs.mapInArrow(run, schema)
    texts = docs.where("text is not null").select(F.sha2(F.col("text").cast("string"), 256).alias("key"), F.col("text").cast("string").alias("text"))
    hit = None
    for block in itertools.chain((first, second), found):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keys(batch: pa.RecordBatch, shared=shared):
            bad = sorted({r for r, *_ in matches(text_of(batch), shared.value)})
            yield {"key": batch.column(0).take(pa.array(bad, pa.int64()))}

        part = checkpointed(map_batches(texts, keys, "key string").distinct())
        shared.unpersist()
        hit = part if hit is None else hit.unionByName(part)
    bad = small(checkpointed(hit.distinct().withColumnRenamed("key", "__key")))
    return docs.join(bad, F.sha2(F.col("text").cast("string"), 256) == F.col("__key"), "left_anti").select(*docs.columns)
