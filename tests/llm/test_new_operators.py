"""Packing, spelling variants and alignment against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tracemill.llm import alignment, packing, queries, segments, spelling

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "é " * 40_000), (5, "<|endoftext|> İ ﬁ \U0001f600 a<|endoftext|>b</s>"), (6, "low ▁ bar"), (7, "x" * 5000), (8, "\r\n\r\n a\x85b \x1c. c  \xa0 d﻿"), (9, "日本語 の テキスト, déjà."), (10, "\x00 nul")]
PARTS = [" ", "  ", "\n", "\t", "\r", "a", "é", "É", "×", "÷", ".", ",", "!", "?", "'s", "'", "<|endoftext|>", "1", "日", "😀", " ", "\x85", "\xa0", "\x1c", "|", "word", "▁", "n't", "-", ":", "<s>", "ǅ", "ⅷ", " ", "the", " The", "ſ"]


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, 1, "s", 9.5, 7) for i, t in ODD], "doc_id bigint, text string, n_a int, word string, offset double, block int")


def whole(spark):
    return queries.table(spark, FOLDER, "documents").select("doc_id", "text").unionByName(odd(spark), True)


def texts_of(spark):
    return [(r.doc_id, r.text) for r in whole(spark).select("doc_id", "text").collect()]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def plain(special):
    library = Tokenizer.from_file(packing.default_vocabulary())
    library.encode_special_tokens = not special
    return lambda text: library.encode(text, add_special_tokens=False).ids


def test_ids_of_segments_equal_library():
    memory, encode = packing._encoded(packing.default_vocabulary()), plain(True)
    texts = random_texts(4000, 1)
    ids, ends = packing.ids_of(pa.array(texts), memory, 0)
    for text, lo, hi in zip(texts, [0, *ends], ends):
        assert ids[lo:hi].tolist() == [*encode(text), 0], text


def test_packing_covers_every_id(spark):
    rows = packing.pack_documents(whole(spark).repartition(3)).collect()
    encode, texts = plain(True), texts_of(spark)
    expected = Counter()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in texts:
        ids = np.array([*encode(text or ""), 0], np.uint32)
        expected[i, len(ids)] += 1
        for r in by[i, len(ids)]:
            if expected[i, len(ids)] == 1 and i != 3:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(by) == set(expected)
    for key, times in expected.items():
        assert Counter(x for r in by[key] for x in range(r.start, r.start + r.length)) == Counter({x: times for x in range(key[1])})
    for pieces in sequences.values():
        pieces.sort()
        assert [x for x, _ in pieces] == list(itertools.accumulate([n for _, n in pieces], initial=0))[:-1]
        size = sum(n for _, n in pieces)
        assert size == 1024 or size & (size - 1) == 0  # no padding at all
    assert len(rows) < 1.25 * len(sequences) + len(texts) + 40  # few documents are cut beyond what their length asks for


def test_level_is_the_least_sum_of_squares():
    rng, packer = random.Random(2), packing.Packer(64)
    count = [0] * 65
    for _ in range(1500):
        size = rng.randrange(1, 64)
        options = []
        for h in range(0, 65 - size):
            if h == 0 or count[h]:
                after = list(count)
                after[h] -= h > 0
                after[h + size] += 1
                options.append((sum(x * x for x in after[1:64]), -h))
        h = -min(options)[1]
        assert packer.level(size) == h
        count[h] -= h > 0
        count[h + size] += 1
        list(packer.add((0, size), np.zeros(size, np.uint32)))
        assert packer.count[1:64].tolist() == count[1:64]


@pytest.mark.parametrize("sizes", [[600] * 50, [1], [1023, 1], [512, 511], list(range(1, 300)), [5000, 700, 700]])
def test_settling_leaves_no_padding(sizes):
    packer = packing.Packer(1024, most=7)
    out = [w for n, k in enumerate(sizes) for w in packer.add((n, k), np.arange(k, dtype=np.uint32))] + list(packer.settle())
    assert packer.open == 0 and sorted((p.doc[0], x) for w in out for p in w for x in p.ids.tolist()) == [(n, x) for n, k in enumerate(sizes) for x in range(k)]
    levels = [sum(len(p.ids) for p in w) for w in out]
    assert all(x & (x - 1) == 0 and x <= 1024 for x in levels) and sum(x < 1024 for x in levels) <= 10 * (1 + len(sizes) // 7)
    assert all(p.ids[0] == p.start for w in out for p in w)


def test_empty_tables(spark):
    none = whole(spark).where("doc_id < -5")
    assert packing.pack_documents(none).count() == spelling.group_variants(none).count() == alignment.align_documents(none).count() == 0


def brute_words(texts):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    """Whether exactly one letter is inserted, deleted or replaced, by common prefix and suffix."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def brute_variants(texts):
    n = brute_words(texts)
    parts = defaultdict(set)  # words that are near share a half at one of three places
    for w in n:
        for at in (0, -1, 1):
            parts["head", w[: max(1, len(w) // 2 + at)]].add(w)
            parts["tail", w[-max(1, len(w) // 2 + at) :]].add(w)
    near = defaultdict(set)
    for group in parts.values():
        for a, b in itertools.combinations(group, 2):
            if one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_equal_brute_force(spark):
    docs = whole(spark)
    base = "abcdefghij ÀÁÂÃÄÅÆÇ strasse straße ooooooo"
    edited = [(100 + k, " ".join([base] * (1 + 40 * (k % 3 == 0)) + [base.replace("d", "", 1), base.replace("f", "ff"), base.replace("straße", "strasße") * 2, "ÿ" * 9, "x" * 3000, "x" * 3001])) for k in range(6)]
    docs = docs.unionByName(spark.createDataFrame(edited, "doc_id bigint, text string"), True)
    expected = brute_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = spelling.group_variants(docs).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == expected and len(rows) == len(expected)
    assert sum(r.form is not None for r in rows) > 3 and max(r.n_near for r in rows) > 1


def test_neighbours_are_distinct_and_complete():
    alphabet = np.array(sorted(map(ord, "abcé")))
    full = np.full(1 << 10, 255, np.uint8)
    for word in ("aabbcab", "aaaaaaa", "abcéabc", "a"):
        found = [x for _, x in spelling.Words([word]).near(alphabet, full)]
        letters = "abcé"
        expected = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in letters} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
        assert sorted(found) == sorted(expected - {word})


def test_long_forms_are_followed_to_the_end(spark):
    """A chain of forms, each ten times as frequent as the one before."""
    chain = ["abcdefg" + "h" * k for k in range(6)]
    texts = [(k, " ".join([w] * 10**p)) for p, w in enumerate(chain[:5], 0) for k in range(1000 * p, 1000 * p + 2)]
    rows = spelling.group_variants(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    expected = brute_variants(texts)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == expected


def test_field_of_few_bits_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BITS", 1 << 16)
    test_variants_equal_brute_force(spark)


def test_crc_of_joined_parts():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(0, 12)), rng.randbytes(rng.choice([0, 1, 7, 8, 300]))) for _ in range(300)]
    size = np.array([len(b) for _, b in pairs])
    joined = spelling.Crc().join(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([zlib.crc32(b) for _, b in pairs], np.uint32), size)
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def brute_links(text, a_encode, a_bytes, piece):
    """A ids, B ids and groups of a text, token by token."""
    if not text:
        return None
    said = (" " + text).encode()
    a, b = a_encode(" " + text), piece.encode(text)
    spell = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [piece.id_to_piece(i)]]
    a_spell = [a_bytes[i] for i in a]
    if b"".join(spell) != said or b"".join(a_spell) != said:
        return None
    groups, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i])
            x += len(a_spell[i])
            i += 1
        else:
            right.append(b[j])
            y += len(spell[j])
            j += 1
        if x == y and left and right:
            groups.append((left, right))
            left, right = [], []
    return a, b, groups


def brute_alignment(texts):
    piece = sentencepiece.SentencePieceProcessor(model_file=alignment.default_vocabularies()[1])
    encode, spelled = plain(False), segments.byte_level(packing.default_vocabulary(), False).bytes
    found = [brute_links(t, encode, spelled, piece) for _, t in texts]
    count = Counter(p for f in found if f for p in {(a, b) for left, right in f[2] for a in left for b in right})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), f in zip(texts, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a, b) for left, right in f[2] for a in left for b in right]
        written = ";".join(f"{','.join(map(str, left))}|{','.join(map(str, right))}" for left, right in f[2])
        out.append((i, len(f[0]), len(f[1]), len(f[2]), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(written.encode()).hexdigest()))
    return sorted(out, key=str)


def test_alignment_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    docs = whole(spark).unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(random_texts(400, 4))], "doc_id bigint, text string"), True)
    rows = alignment.align_documents(docs).collect()
    assert rows[0].__fields__ == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in rows), key=str) == brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_alignment_cuts_blocks_to_rows_that_a_task_can_hold(spark):
    """All of a block's links in one row made joins, sorts and batches hold many megabytes a row, and as many as a task reads blocks."""
    docs = spark.createDataFrame([(k, f"{t} " * 3) for k, t in enumerate(random_texts(3000, 11))], "doc_id bigint, text string").coalesce(1)
    rows = alignment._blocks(docs, *alignment.default_vocabularies())
    most = rows.selectExpr("max(size(pair))", "max(size(which))", "max(size(ends))", "sum(size(ends))").first()
    assert most[0] <= 1_024 and most[1] <= 8_192 and most[2] <= 256 and most[3] == 3000


def test_intervals_and_products():
    rng = random.Random(6)
    for _ in range(200):
        end = rng.randrange(1, 40)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randrange(0, end)), end})) for _ in range(2))
        ends, own_a, own_b, shared = alignment.overlaps(a, b)
        assert ends.tolist() == sorted({*a.tolist(), *b.tolist()}) and ends[shared].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        starts = [0, *ends.tolist()]
        for k, (x, y) in enumerate(zip(own_a, own_b)):
            assert all(([0, *v][o] <= starts[k]) and v[o] >= ends[k] for v, o in ((a.tolist(), x), (b.tolist(), y)))
        _, x, y = alignment.products(*alignment.grouped(a, b))
        group = lambda v, k: sum(e < v[k] for e in ends[shared].tolist())
        assert sorted(zip(x.tolist(), y.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if group(a, i) == group(b, j)]


def test_wide_groups_keep_their_counts():
    """A group whose product is long is counted from its distinct ids."""
    a_ids, b_ids = np.array([1, 2] * 100), np.array([7, 8, 9] * 50)
    of = np.zeros(1, np.int64)
    pair, times, n = alignment.Aligned._pairs(a_ids, b_ids, np.array([200]), np.array([150]), of, 1)
    assert n.tolist() == [6] and times.tolist() == [5000] * 6 and sorted(pair.tolist()) == [a << 32 | b for a in (1, 2) for b in (7, 8, 9)]
