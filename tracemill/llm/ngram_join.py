"""Exact Jaccard self-join on word n-grams: rare-first prefixes, length, positional and suffix filters.

Steps, none of which holds more than a bounded slice, a bounded block or a fixed-size table in one task:

1. Shingles of all texts are counted into a fixed number of buckets. The counts only order the
   shingles of a set (rare first, then by hash); any order gives the same links.
2. Each text becomes one row: size, fingerprint, prefix (the first n - ceil(t n) + 1 shingles) and a
   signature (how many shingles fall to each of 256 ranges). Equal sets are one class from here on.
3. Prefix shingles that classes of fitting sizes share become postings. Shingles of very many classes
   are counted first and skip that test, which reads a shingle's postings in order in one task.
4. Leader round: each posting is held against one leader of its shingle (of its block in a long list).
   Pairs that pass the filters are verified on whole sets, and links give components. Block rounds: in
   lists with many postings outside of the largest component, each of these is held against one block
   of the list, and its nearest pairs are verified. Rounds go on while they find links and much would
   be left for step 5; a posting is dealt once in a round and gives a few pairs at most.
5. All remaining pairs of different components are held against the filters: within a shingle and a
   band of sizes, the postings of the largest component and those of the others are cut to blocks, and
   blocks are paired but for two of the largest component. Pairs that pass are verified once each. Pairs
   inside a component can't change the components, so none that matters is skipped.

Filters for sizes x, y and overlap bound a = ceil(t / (1 + t) * (x + y)): length (t max <= min),
positional (1 + what follows the common shingle reaches a) and suffix (the signatures' differences
bound the overlap from above; for long texts again by finer signatures, before sets are moved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import anew, checkpointed, merged, released, small
from .kernels import entered, lists, map_batches, mix, shingles, slices, text_of

_BUCKET_BITS, _CHUNKS = 21, 128
#: Ranges of a signature, each counted up to 15.
SIGNATURE = 256
#: Shingles from which on a text has a fine signature too, of as many ranges as an eighth of its shingles or up to twice that.
FINE = 1024
#: Postings of one shingle that a task compares at once; longer lists are cut to blocks and paired.
BLOCK = 256
#: Leaders or nearest ones that a class is verified against in one round, and rounds at most; what they leave is compared afterwards.
LEADERS, ROUNDS = 3, 6
#: Rows for each posting that the comparison of blocks may take before another round is tried.
DEALT = 4
#: Postings outside of a list's largest component from which on block rounds look for their nearest ones.
CROWD = 16


def _rows(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, distinct shingle) fall to each of 2**21 hash buckets, over all documents (a task reports 65535 at most)."""
    width = (1 << _BUCKET_BITS) // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered(__name__)
        total = np.zeros(1 << _BUCKET_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                np.add.at(total, (shingles(text_of(part), k)[0] >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), 1)
        total = np.minimum(total, 65535).astype(np.uint16)
        rows = [total[i * width : (i + 1) * width].tobytes() for i in range(_CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(rows, pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    out = np.zeros(1 << _BUCKET_BITS, np.int64)
    for row in _rows(docs).select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(bytes(row.counts), np.int64)
    return out


def shingle_sets(docs: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """One row per document: doc_id, n, fp1, fp2 (fingerprint of the set), prefix (rare first), dense (whether a prefix shingle may be in more than LONG_LIST sets), sig."""
    ranks = np.minimum(16 * np.log2(counts + 1), 255).astype(np.uint8)  # one byte tells rare from common well enough
    shared = docs.sparkSession.sparkContext.broadcast((ranks, np.packbits(counts > LONG_LIST)))

    def run(batch: pa.RecordBatch):
        h, row = shingles(text_of(batch), k)
        rows = batch.num_rows
        n = np.bincount(row, minlength=rows)
        begin = np.cumsum(n) - n
        fp = np.zeros((2, rows), np.int64)
        some = n > 0
        if len(h):
            m = mix(h + np.uint64(0x1234567))
            fp[0, some] = np.add.reduceat(m, begin[some]).view(np.int64)
            fp[1, some] = np.bitwise_xor.reduceat(mix(m), begin[some]).view(np.int64)
        sig = np.minimum(np.bincount(row * SIGNATURE + (h & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=rows * SIGNATURE), 15).astype(np.uint8)
        sig = sig[0::2] << 4 | sig[1::2]
        bucket = (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
        order = np.lexsort((h, shared.value[0][bucket], row))
        size = np.where(some, n - -(-percent * n // 100) + 1, 0)
        place = np.arange(len(h)) - np.repeat(begin, n)
        first = order[place < np.repeat(size, n)]
        dense = (shared.value[1][bucket[first] >> 3] >> (7 - (bucket[first] & 7)).astype(np.uint8) & 1).astype(bool)
        fine = [_fine(h[a : a + k]) if k >= FINE else b"" for a, k in zip(begin.tolist(), n.tolist(), strict=True)]
        yield {
            "fine": pa.array(fine, pa.binary()), "doc_id": batch.column(0), "n": pa.array(n, pa.int64()), "fp1": pa.array(fp[0]), "fp2": pa.array(fp[1]), "prefix": lists(h[first].view(np.int64), size, pa.int64()), "dense": lists(dense, size, pa.bool_()),
            "sig": pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGNATURE // 2), rows, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()),
        }

    return map_batches(_rows(docs), run, "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, dense array<boolean>, sig binary, fine binary")


def _fine(h: np.ndarray) -> bytes:
    """How many hashes fall to each range by their last bits; empty if a count doesn't fit."""
    size = 1 << int(len(h) // 8).bit_length()
    counts = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint16).tobytes() if counts.max() < 65536 else b""


def _pass(percent: int, nx: np.ndarray, ny: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length and positional filters, and the overlap that a pair needs."""
    need = -(-percent * (nx + ny) // (100 + percent))
    ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (1 + np.minimum(nx - i - 1, ny - j - 1) >= need)
    return ok, need


def _signatures(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SIGNATURE // 2)
    return np.concatenate([packed >> 4, packed & 15], 1)


def _out(a: np.ndarray, b: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (np.minimum(a, b), np.maximum(a, b), gap)], ["a", "b", "gap"])


#: Neighbours in order of size that a posting is held against before it counts as open without further tests.
NEIGHBOURS = 48
#: Postings of one shingle from which on all count as open.
LONG_LIST = 8192


def _with_partner(percent: int, neighbours: int):
    """Streams postings sorted by (token, n); those are kept that may pass the length and positional filters with another posting of their token."""

    def keep(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token, n, pos = (table.column(c).to_numpy() for c in ("token", "n", "pos"))
        open_, near = np.zeros(len(token), bool), np.arange(len(token))
        for lag in range(1, neighbours + 1):
            at = near[near >= lag]
            near = at[(token[at] == token[at - lag]) & (100 * n[at - lag] >= percent * n[at])]
            ok = _pass(percent, n[near], n[near - lag], pos[near], pos[near - lag])[0]
            open_[near[ok]] = open_[near[ok] - lag] = True
        open_[near] = open_[near - neighbours] = True  # these have more neighbours than were tried
        yield from table.filter(pa.array(open_)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the postings of one token, no more than LONG_LIST
        for batch in batches:
            if not batch.num_rows:
                continue
            token = np.asarray(batch.column("token"))
            cut = int(np.searchsorted(token, token[-1]))
            if cut or held and held[-1].column("token")[-1].as_py() != token[0]:
                yield from keep(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from keep(pa.Table.from_batches(held))

    return run


def _against_leader(percent: int):
    """Streams postings sorted by token; the first of each token is its leader, those of other components are held against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # token, cid, comp, n, pos and signature of the current leader
        for batch in batches:
            if not batch.num_rows:
                continue
            token, cid, comp, n, pos = (np.asarray(batch.column(c)) for c in ("token", "cid", "comp", "n", "pos"))
            sig = _signatures(batch.column("sig")).astype(np.int16)
            if last is not None:
                token, cid, comp, n, pos = (np.concatenate([[x], y]) for x, y in zip(last[:5], (token, cid, comp, n, pos), strict=True))
                sig = np.concatenate([last[5], sig])
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            ok, need = _pass(percent, n, n[lead], pos, pos[lead])
            at = np.flatnonzero(ok & (comp != comp[lead]))
            gap = np.abs(sig[at] - sig[lead[at]]).sum(1)
            at, gap = (x[(n[at] + n[lead[at]] - gap) // 2 >= need[at]] for x in (at, gap))
            if len(at):
                yield _out(cid[at], cid[lead[at]], gap)
            k = lead[-1]
            last = (token[k], cid[k], comp[k], n[k], pos[k], sig[k : k + 1])

    return run


def _across(percent: int, best: int = 0):
    """Streams postings sorted by (token, band, block pair); pairs of different components are held against the filters, but for two visitors of the band.

    With best, each block is paired with itself alone, and postings of side 1 give that many nearest pairs each.
    """

    def pairs(n, pos, sig, cid, comp, visits, side, alone: bool) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(n))
        left, right = (np.flatnonzero(side == 1), every) if best else (every, every) if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        for lo in range(0, len(left), 64):
            x = left[lo : lo + 64, None]
            y = right[None, :]
            ok, need = _pass(percent, n[x], n[y], pos[x], pos[y])
            ok &= (comp[x] != comp[y]) & ~(visits[x] & visits[y])
            if alone and not best:
                ok &= np.arange(lo, lo + len(x))[:, None] < np.arange(len(right))[None, :]
            i, j = np.nonzero(ok)
            passed = []
            for part in range(0, len(i), 16384):
                a, b = x[i[part : part + 16384], 0], right[j[part : part + 16384]]
                gap = np.abs(sig[a].astype(np.int16) - sig[b]).sum(1)
                keep = (n[a] + n[b] - gap) // 2 >= need[i[part : part + 16384], j[part : part + 16384]]
                if keep.any() and not best:
                    yield _out(cid[a[keep]], cid[b[keep]], gap[keep])
                passed.append((a[keep], b[keep], gap[keep]))
            if best and passed:
                a, b, gap = (np.concatenate(column) for column in zip(*passed, strict=True))
                a, b, gap = (column[np.lexsort((cid[b], gap / (n[a] + n[b]), a))] for column in (a, b, gap))
                few = np.arange(len(a)) - np.searchsorted(a, a) < best
                yield _out(cid[a[few]], cid[b[few]], gap[few])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(pair: int) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            n, pos, cid, comp, visits, side = (t.column(c).to_numpy() for c in ("n", "pos", "cid", "comp", "visits", "side"))
            if pair < 0 or side.any() and not side.all():
                yield from pairs(n, pos, _signatures(t.column("sig").combine_chunks()), cid, comp, visits, side, pair < 0)

        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column(c)) for c in ("token", "band", "pair")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now], axis=0)) + 1
            for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
                at = tuple(x[lo] for x in now)
                if at != key:
                    if held:
                        yield from flush(key[2])
                    held, key = [], at
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush(key[2])

    return run


def _finer(percent: int):
    """Streams pairs with sizes and fine signatures; those stay whose common ranges allow the overlap that they need, or that lack a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c), np.int64) for c in ("na", "nb"))
            need = -(-percent * (na + nb) // (100 + percent))
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)):
                if x and y:
                    x, y = (np.frombuffer(v, np.uint16).astype(np.int64) for v in (x, y))
                    size = min(len(x), len(y))  # ranges go by last bits, so a longer signature folds to a shorter one
                    keep[i] = np.minimum(x.reshape(-1, size).sum(0), y.reshape(-1, size).sum(0)).sum() >= need[i]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def fitting(pairs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that a finer suffix filter lets pass; long texts fill the short signature, so that it tells them apart no more."""
    side = lambda c: named.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"f{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_finer(percent), "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the checkpointed pairs (a, b) whose shingle sets reach the similarity, each set made anew from its text."""
    need = checkpointed(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())

    def run(batch: pa.RecordBatch):
        h, row = shingles(text_of(batch), k)
        yield {"doc_id": batch.column(0), "set": lists(h.view(np.int64), np.bincount(row, minlength=batch.num_rows), pa.int64())}

    sets = map_batches(_rows(docs).join(small(need), "doc_id", "left_semi"), run, "doc_id long, set array<long>")
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s"))
    return checkpointed(common.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b").distinct())


def _postings(named: DataFrame, percent: int) -> DataFrame:
    """Checkpointed (token, cid, n, pos, sig) of the classes' prefix shingles that may have a partner.

    A class is represented by its row of least doc_id; prefixes stay where they are, and only rows that
    repeat another's set are looked up.
    """
    slim = named.select("row", "doc_id", "n", "fp1", "fp2")
    first = slim.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    again = slim.select("row", anew("fp1").alias("k1"), anew("fp2").alias("k2"), "n").join(first.select(anew("fp1").alias("k1"), anew("fp2").alias("k2"), "n", F.col("first.row").alias("first")).hint("merge"), ["k1", "k2", "n"])
    again = checkpointed(again.where("row <> first").select("row"))
    postings = named.join(small(again), "row", "left_anti").select(F.col("doc_id").alias("cid"), "n", "dense", F.posexplode("prefix").alias("pos", "token"))
    long = checkpointed(postings.where(F.get("dense", F.col("pos"))).groupBy("token").count().where(F.col("count") > LONG_LIST).select("token"))
    packed = postings.select("token", (F.shiftleft(F.col("n"), 32) + F.col("pos")).alias("size"), "cid", F.get("dense", F.col("pos")).alias("dense"))
    unpacked = lambda df: df.select("token", "cid", F.shiftright("size", 32).alias("n"), F.col("size").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("pos"))
    short, open_ = packed.drop("dense"), None
    if not long.isEmpty():
        short = packed.join(small(long), "token", "left_anti").drop("dense")
        open_ = unpacked(packed.where("dense").join(small(long), "token", "left_semi"))
    near = Window.partitionBy("token").orderBy("size", "cid")
    n = lambda c: F.shiftright(c, 32)
    sized = short.withColumns({"less": n(F.lag("size").over(near)), "more": n(F.lead("size").over(near))})
    shared = unpacked(sized.where((100 * F.col("less") >= percent * n("size")) | (100 * n("size") >= percent * F.col("more"))).sortWithinPartitions("token", "size", "cid"))
    shared = shared.mapInArrow(_with_partner(percent, NEIGHBOURS), "token long, cid long, n long, pos int")
    shared = shared if open_ is None else shared.unionByName(open_)
    signed = named.select(F.col("doc_id").alias("cid"), "n", "sig").distinct()
    return checkpointed(shared.join(signed, ["cid", "n"]).select("token", "cid", "n", "pos", "sig"))


def _mixed(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Postings by band of sizes, and checkpointed (token, band) with different components: the largest one, its blocks (bm) and those of the others (bo).

    Sizes that fit differ by one band at most; a posting is at home in its band and visits the one below.
    """
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent * 1.0001))).cast("long")
    spread = placed.withColumn("b", band).withColumn("v", F.explode(F.array(F.lit(False), F.lit(True)))).select("*", (F.col("b") - F.col("v").cast("int")).alias("band"), F.col("v").alias("visits")).drop("b", "v")
    sizes = spread.groupBy("token", "band", "comp").agg(F.count("*").alias("c"), F.count_if(~F.col("visits")).alias("home"))
    lists_ = sizes.groupBy("token", "band").agg(F.sum("c").alias("m"), F.sum("home").alias("home"), F.max("c").alias("mc"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    up = lambda c: F.ceil(c / BLOCK)
    return spread, checkpointed(lists_.where("lo < hi and home > 0").select("token", "band", "major", "m", "mc", up(F.col("mc")).alias("bm"), up(F.col("m") - F.col("mc")).alias("bo")))


def _led(shared: DataFrame, placed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the filters against a leader, LEADERS best ones for each class."""
    heavy = checkpointed(shared.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select(anew("token").alias("key"), F.ceil(F.col("m") / BLOCK).alias("blocks")))
    salted = placed.withColumn("key", anew("token")).join(small(heavy), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("cid", "token", F.lit(turn)), F.col("blocks")), F.lit(0)))  # by token too, so that blocks of different tokens mix
    salted = salted.select(F.xxhash64("token", "salt").alias("token"), "cid", "comp", "n", "pos", "sig")  # a leader for each block of a long list
    led = salted.repartition("token").sortWithinPartitions("token", F.xxhash64("token", "cid", F.lit(turn)), "cid", "pos").mapInArrow(_against_leader(percent), "a long, b long, gap long")
    return _best(led)


def _near(spread: DataFrame, crowded: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of classes that pass the filters within a block of a crowded list (token, band), LEADERS best ones for each class.

    Every posting is in one block of its list; those outside of the list's largest component give their nearest ones.
    """
    lists_ = crowded.select(anew("token").alias("key"), "band", "major", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    open_ = spread.withColumn("key", anew("token")).join(small(lists_), ["key", "band"])
    block = -1 - F.pmod(F.xxhash64("cid", "token", "band", F.lit(turn)), F.col("blocks"))
    units = open_.select("token", "band", block.alias("pair"), (F.col("comp") != F.col("major")).cast("int").alias("side"), "visits", "cid", "n", "pos", "sig", "comp")
    return _best(units.repartition("token", "band", "pair").sortWithinPartitions("token", "band", "pair", "cid", "pos").mapInArrow(_across(percent, LEADERS), "a long, b long, gap long"))


def _best(led: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, gap) that are among the LEADERS nearest ones of a or b."""
    led = led.groupBy("a", "b").agg(F.min("gap").alias("gap"))
    best = Window.partitionBy("x").orderBy("gap", "a", "b")
    chosen = led.select("a", "b", "gap", F.explode(F.array("a", "b")).alias("x")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= LEADERS)
    return chosen.select("a", "b").distinct()


def _linked(docs: DataFrame, named: DataFrame, shared: DataFrame, percent: int, k: int) -> DataFrame:
    """(id, component) of the classes that any link joins; a round's links are merged into the components of those before."""
    total = shared.count()
    labels = tried = before = None
    for turn in range(ROUNDS + 1):
        placed = shared.withColumn("comp", F.col("cid"))
        if labels is not None:
            known = labels.withColumnRenamed("id", "cid").withColumnRenamed("component", "comp")
            placed = shared.join(small(known), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
            spread, mixed = _mixed(placed, percent)
            dealt = mixed.agg(F.sum(F.col("mc") * F.col("bo") + (F.col("m") - F.col("mc")) * (F.col("bm") + F.col("bo")))).first()[0] or 0
            crowded = mixed.where(F.col("m") - F.col("mc") > CROWD)
            left = crowded.agg(F.sum((F.col("m") - F.col("mc")) * F.col("m"))).first()[0] or 0
            idle = before is not None and 2 * left > before and dealt <= DEALT * total
            if left <= total or idle or not new or turn == ROUNDS:
                break
            before = left
        pairs = _led(shared, placed, percent, turn) if labels is None else _near(spread, crowded, percent, turn)
        pairs = checkpointed(fitting(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), named, percent))
        found = verified(docs, pairs, k, percent)
        new = found.count()
        labels, tried = merged(labels, found), pairs if tried is None else tried.unionByName(pairs)
        released(docs.sparkSession)

    open_ = spread.withColumn("key", anew("token")).join(small(mixed.select(anew("token").alias("key"), "band", "major", "bm", "bo")), ["key", "band"]).drop("key")
    is_major = F.col("comp") == F.col("major")
    own = F.pmod(F.xxhash64("cid"), F.when(is_major, F.col("bm")).otherwise(F.col("bo")))
    to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    unit = lambda pair, side: F.struct(pair.cast("long").alias("pair"), side.alias("side"))
    # Block pairs: the largest component's with the others', then the others' with each other; below 0, a block with itself.
    with_others = F.transform(to("bo"), lambda j: unit(F.col("own") * F.col("bo") + j, F.lit(0)))
    with_major = F.transform(to("bm"), lambda i: unit(i * F.col("bo") + F.col("own"), F.lit(1)))
    apart = lambda j: F.when(j == F.col("own"), -1 - j).otherwise((F.col("bm") + F.least("own", j)) * F.col("bo") + F.greatest("own", j))
    among = F.transform(to("bo"), lambda j: unit(apart(j), F.when(F.col("own") > j, 1).otherwise(0)))
    units = open_.withColumn("own", own).withColumn("u", F.explode(F.when(is_major, with_others).otherwise(F.concat(with_major, among))))
    dealt = units.select("token", "band", F.col("u.pair").alias("pair"), F.col("u.side").alias("side"), "visits", "cid", "n", "pos", "sig", "comp")
    crossed = dealt.repartition("token", "band", "pair").sortWithinPartitions("token", "band", "pair").mapInArrow(_across(percent), "a long, b long, gap long")
    second = checkpointed(fitting(crossed.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), named, percent))
    open_ = units = dealt = crossed = placed = spread = None
    released(docs.sparkSession)
    return merged(labels, verified(docs, second, k, percent))


def jaccard_components(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles (words
    are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of fewer words is one shingle); component_id
    is the least doc_id that links reach, itself included. An empty or null text has no shingles and
    links with nothing. Rows that repeat a doc_id are one document with several texts. A row with a
    null doc_id gets the null component and links with nothing. Ties, an empty table and further
    columns need no care. Shingles are compared by 64-bit hashes.
    """
    rows = checkpointed(shingle_sets(docs, k, percent, shingle_counts(docs, k)).withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("n > 0 and doc_id is not null")
    shared = _postings(named, percent)
    released(docs.sparkSession)
    reached = _linked(docs, named, shared, percent, k)

    label = named.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("cid")).join(reached.withColumnRenamed("id", "cid"), "cid", "left")
    label = checkpointed(label.select("fp1", "fp2", "n", F.coalesce("component", "cid").alias("component")))
    key = [anew("fp1").alias("k1"), anew("fp2").alias("k2"), F.col("n").alias("k3")]
    found = rows.select("doc_id", "n", *key).join(label.select(*key, "component").hint("merge"), ["k1", "k2", "k3"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_each(docs: DataFrame, percent: int = 90, k: int = 3) -> DataFrame:
    """The documents, all columns kept, without those whose component has a smaller doc_id; rows without a doc_id stay.

    Of rows that repeat a doc_id one stays.
    """
    found = jaccard_components(docs, percent, k)
    out = checkpointed(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(small(out), "doc_id", "left_anti").select(*docs.columns)
    repeated = checkpointed(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    ids = small(repeated)
    return kept.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(ids, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
