"""Alignment of two tokenizers' tokens through elementary intervals.

The ends of both tokenizers' tokens, united, cut a text's bytes into elementary intervals; `searchsorted` in either array of ends
finds the token that owns an interval, so each interval is one overlap of an A and a B token. Ends that both share close a group,
and the product of a group's A and B tokens are its links. As every segment's end is shared (see segments), groups, links and
overlaps are found once for each distinct segment.

Corpus-wide counts of id pairs: documents are handled in blocks of bounded bytes. A block's rows hold its documents' links as
indices into the block's distinct pairs, some of each in a row. Pairs are counted by block, summed over blocks by shuffle, and each block
gets the counts of its own pairs back, ahead of its links in a sort: what is shuffled follows the distinct pairs of blocks, not the links,
and a task holds the counts of one block at a time, however many blocks it reads.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import segments
from .graph import shared_folder
from .kernels import entered, holds, released, text_of

#: Bytes of text whose documents are one block; a longer document is a block of its own.
BLOCK = 4 << 20
#: Pairs, documents and links of a row of a block at most, but for a document of more links; and bytes of a row group of the stored rows, which a reader has in memory at once.
PAIRS, DOCUMENTS, LINKS, ROW_GROUP = 1_024, 256, 8_192, 8 << 20
#: Distinct segments that a worker remembers, and encodes at once: with their pairs and digests one takes many times its bytes.
MEMORY, TURN = 250_000, 1 << 14
_PAIR = 32  # bits of a pair's B id

FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCKS = "block long, piece int, pair array<long>, docs array<int>, ends array<int>, which array<int>, times array<int>, " + ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in FACTS.split(", "))
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def default_vocabularies() -> tuple[str, str]:
    """The paths of the public vocabularies, byte-level and of pieces, that are installed beside the engine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """B: a piece vocabulary whose library puts a space before each text."""

    def __init__(self, path: str) -> None:
        self.library = segments.pieces(path)
        lib = self.library
        if lib.id_to_piece(lib.encode("a\n")[-1]) != "<0x0A>":
            raise ValueError("another kind of vocabulary: no piece for each byte")
        self.bytes = [bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace("▁", " ").encode() for i in range(lib.vocab_size())]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def __call__(self, new: list[bytes]) -> list[list[int]]:
        """Ids of segments. One that begins with a space lends it to the library; else a line feed, which no piece goes beyond, is put first and its two tokens dropped."""
        lent = [s[:1] == b" " and len(s) > 1 for s in new]  # an empty text gets no space
        found = self.library.encode([s[1:].decode() if x else "\n" + s.decode() for s, x in zip(new, lent)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(found, lent)]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elementary intervals of two arrays of ends that end alike: their ends, the A and the B token that owns each, and whether both end there."""
    ends = np.union1d(a_ends, b_ends)
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, a, b, (a_ends[a] == ends) & (b_ends[b] == ends)


def grouped(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last A and the last B token, exclusive, of every group in order."""
    _, a, b, shared = overlaps(a_ends, b_ends)
    return a[shared] + 1, b[shared] + 1


def products(a_stop: np.ndarray, b_stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group, A and B token of all links."""
    na, nb = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
    n = na * nb
    group = np.repeat(np.arange(len(n)), n)
    place = segments.spread(np.zeros(len(n), np.int64), n)
    return group, (a_stop - na)[group] + place // nb[group], (b_stop - nb)[group] + place % nb[group]


class Aligned:
    """Facts about segments under two vocabularies: how many tokens, groups and links, and the links' distinct id pairs with their times."""

    KINDS = {"fit": bool, "n_a": np.int64, "n_b": np.int64, "n_groups": np.int64, "pair": np.int64, "times": np.int64}

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = segments.byte_level(a_path, False), Pieces(b_path)
        self.text: list[bytes] = []
        self.memory = segments.Memory(self.encode, self.KINDS, MEMORY, TURN)

    def encode(self, new: list[bytes]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        if not self.memory.at:
            self.text.clear()
        b_ids, b_count = segments.flat(self.b(new))
        a_ids, a_count = self.a(new)
        size = np.fromiter(map(len, new), np.int64, len(new))
        said = b"".join(map(self.b.bytes.__getitem__, b_ids.tolist()))
        b_ends, at = np.cumsum(self.b.size[b_ids]), np.concatenate([[0], np.cumsum(b_count)])
        got = np.diff(np.concatenate([[0], b_ends])[at])
        fit = got == size
        if not fit.all() or said != b"".join(new):  # a segment that the library spells in another way, as U+2581
            begin = np.concatenate([[0], b_ends])[at[:-1]]
            fit &= np.fromiter((said[k : k + n] == s for k, n, s in zip(begin.tolist(), size.tolist(), new)), bool, len(new))
            a_ids, b_ids = a_ids[np.repeat(fit, a_count)], b_ids[np.repeat(fit, b_count)]
            a_count, b_count = a_count * fit, b_count * fit
        a_stop, b_stop = grouped(np.cumsum(self.a.size[a_ids]), np.cumsum(self.b.size[b_ids]))
        of = np.searchsorted(np.cumsum(a_count), a_stop)  # segment of each group
        n_groups = np.bincount(of, minlength=len(new))
        self._write(a_ids, b_ids, a_stop, b_stop, n_groups)
        pair, times, n_pair = self._pairs(a_ids, b_ids, a_stop, b_stop, of, len(new))
        one = np.ones(len(new), np.int64)
        return {"fit": (fit, one), "n_a": (a_count, one), "n_b": (b_count, one), "n_groups": (n_groups, one), "pair": (pair, n_pair), "times": (times, n_pair)}

    @staticmethod
    def _pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each segment with their times; wide groups one by one, from their distinct ids, so that a product is never longer than these."""
        na, nb = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        wide = np.flatnonzero(na * nb > 4096)
        keep = np.ones(len(na), bool)
        keep[wide] = False
        g, x, y = _products_of(a_stop, b_stop, na, nb, np.flatnonzero(keep))
        parts = [(of[g], a_ids[x] << _PAIR | b_ids[y], np.ones(len(g), np.int64))]
        for k in wide.tolist():
            a, p = np.unique(a_ids[a_stop[k] - na[k] : a_stop[k]], return_counts=True)
            b, q = np.unique(b_ids[b_stop[k] - nb[k] : b_stop[k]], return_counts=True)
            parts.append((np.full(len(a) * len(b), of[k]), (a[:, None] << _PAIR | b[None, :]).ravel(), (p[:, None] * q[None, :]).ravel()))
        seg, pair, times = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pair, seg))
        seg, pair, times = seg[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (pair[1:] != pair[:-1])])) if len(seg) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, first) if len(first) else times
        return pair[first], times, np.bincount(seg[first], minlength=n)

    def _write(self, a_ids: np.ndarray, b_ids: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray, n_groups: np.ndarray) -> None:
        """Remembers the groups of each segment as written in the digest: ids in the order of their groups, A before B, each after its separator."""
        na, nb = np.diff(a_stop, prepend=0), np.diff(b_stop, prepend=0)
        a_first, b_first = a_stop - na + b_stop - nb, a_stop + b_stop - nb
        ids, mark = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        ids[np.arange(len(a_ids)) + np.repeat(b_stop - nb, na)] = a_ids
        ids[np.arange(len(b_ids)) + np.repeat(a_stop, nb)] = b_ids
        mark[a_first], mark[b_first] = ord(";"), ord("|")
        written, ends = _decimal(ids, mark)
        begins = np.append(np.concatenate([[0], ends])[a_first], len(written))
        stop = np.cumsum(n_groups)
        line = written.tobytes()
        self.text += [line[x + 1 : y] for x, y in zip(begins[stop - n_groups].tolist(), begins[stop].tolist())]


_TEN = 10 ** np.arange(1, 19)


def _decimal(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in decimal, each after its mark, and where each ends."""
    digits = 1 + np.searchsorted(_TEN, ids, "right")
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - digits - 1] = mark
    left, at, rest = digits, ends - 1, ids
    while len(rest):
        out[at] = ord("0") + rest % 10
        on = left > 1
        left, at, rest = left[on] - 1, at[on] - 1, rest[on] // 10
    return out, ends


def _products_of(a_stop, b_stop, na, nb, groups):
    n = (na * nb)[groups]
    group = np.repeat(groups, n)
    place = segments.spread(np.zeros(len(n), np.int64), n)
    return group, (a_stop - na)[group] + place // nb[group], (b_stop - nb)[group] + place % nb[group]


@functools.lru_cache(maxsize=1)
def _aligned(a_path: str, b_path: str) -> Aligned:
    """A worker's memory of segments, kept from task to task."""
    holds(__name__, _aligned.cache_clear)
    return Aligned(a_path, b_path)


def block(doc_id: pa.Array, texts: pa.Array, aligned: Aligned) -> dict[str, np.ndarray | pa.Array]:
    """The row of a block: its distinct pairs with the number of its documents that hold them linked, its documents' links, and their facts."""
    n = len(texts)
    filled = np.asarray(pc.binary_length(texts)) > 0
    run, row = segments.of_texts(pc.binary_join_element_wise(" ", texts, ""), aligned.memory)
    runs = aligned.memory.runs
    fit = filled & (np.bincount(row, ~runs["fit"].values[run], n) == 0)
    run, row = run[fit[row]], row[fit[row]]
    totals = {name: np.bincount(row, runs[name].values[run], n).astype(np.int64) for name in ("n_a", "n_b", "n_groups")}
    digests, stops = [""] * n, np.searchsorted(row, np.arange(n + 1))
    text, places = aligned.text, run.tolist()
    for k in np.flatnonzero(fit).tolist():
        digests[k] = hashlib.sha256(b";".join([text[x] for x in places[stops[k] : stops[k + 1]]])).hexdigest()
    # segments of a document, then their pairs, each once with its times
    width = np.int64(len(aligned.memory.at) + 1)
    seen, often = np.unique(row * width + run, return_counts=True)
    row, run = seen // width, seen % width
    count = runs["pair"].counts(run)
    here = np.unique(run)
    pair, local = np.unique(runs["pair"].take(here), return_inverse=True)
    begin = np.cumsum(runs["pair"].counts(here)) - runs["pair"].counts(here)
    which = local[segments.spread(begin[np.searchsorted(here, run)], count)]
    times = runs["times"].take(run) * np.repeat(often, count)
    key = np.repeat(row, count) * np.int64(len(pair) + 1) + which
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(times, first) if len(first) else times
    held, which = key[first] // (len(pair) + 1), key[first] % (len(pair) + 1)
    return {
        "pair": pair, "docs": np.bincount(which, minlength=len(pair)).astype(np.int32), "ends": np.searchsorted(held, np.arange(n), "right").astype(np.int32),
        "which": which.astype(np.int32), "times": times.astype(np.int32), "doc_id": doc_id, **totals,
        "n_links": np.bincount(held, times, n).astype(np.int64), "groups_sha256": pa.array(digests, pa.string()),
    }


def _pieces(found: dict[str, np.ndarray | pa.Array]) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """A block's row cut to rows that hold some of its pairs and some of its documents."""
    pair, ends = found["pair"], found["ends"].astype(np.int64)
    at = lo = 0
    while at < len(pair) or lo < len(ends):
        first = int(ends[lo - 1]) if lo else 0
        hi = min(max(int(np.searchsorted(ends, first + LINKS, "right")), lo + 1), lo + DOCUMENTS, len(ends))
        last = int(ends[hi - 1]) if hi else 0
        cut = {k: found[k][at : at + PAIRS] for k in ("pair", "docs")} | {k: found[k][first:last] for k in ("which", "times")}
        yield cut | {"ends": (ends[lo:hi] - first).astype(np.int32)} | {x.split()[0]: found[x.split()[0]][lo:hi] for x in FACTS.split(", ")}
        at, lo = at + PAIRS, hi


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        aligned = _aligned(a_path, b_path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in segments.by_bytes(batch, limit=BLOCK):
                number += 1
                for piece, row in enumerate(_pieces(block(part.column(0), text_of(part), aligned))):
                    columns = [x if isinstance(x := row[k], pa.Array) else pa.array(x) for k in names[2:]]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([piece], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]], names)
            released()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, BLOCKS)


def _settled(rows: DataFrame) -> DataFrame:
    """Documents with the corpus-wide counts of their links' pairs. Rows come sorted by block: first its counts (at, counts), in stretches of PAIRS, then its documents.

    A count is doubled, and odd where it is its A id's highest.
    """
    kinds = [x.split() for x in FACTS.split(", ")]
    names = [k for k, _ in kinds[:-1]] + ["n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        now, told, by = None, [], np.zeros(0, np.int64)
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k, (number, counted) in enumerate(zip(column["block"].to_pylist(), column["counted"].to_pylist())):
                get = lambda name: column[name][k].values  # noqa: B023, E731
                if number != now:
                    now, told, by = number, [], np.zeros(0, np.int64)
                if counted:
                    stretch = np.empty(len(column["at"][k]), np.int64)
                    stretch[get("at").to_numpy(zero_copy_only=False)] = get("counts").to_numpy(zero_copy_only=False)
                    told.append(stretch)
                    continue
                if told:
                    by, told = np.concatenate(told), []
                which, times, ends = (get(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("which", "times", "ends"))
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                found = {x: get(x) for x, _ in kinds}
                of = by[which] if len(which) else np.zeros(0, np.int64)
                best, total = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
                np.add.at(best, doc, times * (of & 1))
                np.add.at(total, doc, times * (of >> 1))
                found |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
                yield pa.RecordBatch.from_arrays([found[x] for x in names], names)

    return rows.mapInArrow(run, FACTS.replace("groups_sha256", "n_best long, count_sum long, groups_sha256"))


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, before which it puts a space; special strings are plain text. Null and empty texts,
    and those whose tokens' bytes, joined, aren't the space and the text under both, have no tokens: zeros and an empty digest.
    n_best counts the links whose id pair is held linked by as many documents as any of its A id's pairs; count_sum adds up these
    document counts over all links. Repeated rows and null doc_ids are documents of their own; an empty table gives no rows; other
    columns are not read. A block's links are written once, to the folder in spark.checkpoint.dir, and read by the count and by the
    result.
    """
    a, b = default_vocabularies()
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    _blocks(docs, a_path or a, b_path or b).write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    blocks = spark.read.schema(BLOCKS).parquet(folder)
    held = blocks.select("block", "piece", F.posexplode(F.arrays_zip("pair", "docs"))).select("block", "piece", F.col("pos").alias("at"), "col.pair", "col.docs")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    highest = counts.groupBy(F.shiftright("pair", _PAIR).alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", F.shiftright("pair", _PAIR)).join(highest, "a").select("pair", (2 * F.col("n") + (F.col("n") == F.col("most")).cast("long")).alias("count"))
    back = held.join(judged, "pair").groupBy("block", "piece").agg(F.collect_list(F.struct("at", "count")).alias("c")).select("block", "piece", F.lit(True).alias("counted"), F.col("c.at").alias("at"), F.col("c.count").alias("counts"))
    found = blocks.drop("pair", "docs").where(F.size("ends") > 0).withColumn("counted", F.lit(False))
    rows = found.unionByName(back, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.desc("counted"), "piece")
    return _settled(rows).select(*RESULT)
