import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, queries

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def check(rows, texts):
    """All pieces of all documents, cut and placed as they should be; returns the number of sequences and its lower bound."""
    library = Tokenizer.from_file(JSON)
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        pieces, at = sorted(by[doc_id], key=lambda r: r.piece), 0
        for i, p in enumerate(pieces):
            assert (p.piece, p.start, p.ids_crc32) == (i, at, zlib.crc32(ids[at : at + p.length].tobytes()))
            assert p.length == 1024 or i == 0
            at += p.length
        assert at == len(ids) and (len(ids) > 1024 or len(pieces) == 1)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(sequences), math.ceil(sum(r.length for r in rows) / 1024)


def best_fit(lengths, capacity=1024):
    """The bins of one pass of best fit in falling order, by brute force."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= n]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def fewest(lengths, capacity):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[k]:
                left = list(rooms)
                left[left.index(r)] -= lengths[k]
                place(k + 1, left)
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def test_small_cases_against_an_exact_solver():
    rng = random.Random(4)
    worse = 0
    for _ in range(150):
        lengths = sorted((rng.randrange(10, 70) for _ in range(rng.randrange(1, 10))), reverse=True)
        packed = packing.evolve(lengths, 100, 1, [], [])
        assert sorted(i for b in packed.bins for i in b) == list(range(len(lengths))) and max(packed.fill) <= 100
        assert len(packed.bins) <= best_fit(lengths, 100)
        worse += len(packed.bins) > fewest(lengths, 100)
    assert worse <= 1


def test_evolution_beats_best_fit_and_its_own_start():
    rng = random.Random(0)
    lengths = [rng.randint(180, 520) for _ in range(4000)]
    start = packing.evolve(lengths, 1024, 1, [], [], generations=0)
    packed, bound = packing.evolve(lengths, 1024, 1, [], []), math.ceil(sum(lengths) / 1024)
    assert len(packed.bins) <= len(start.bins) and len(packed.bins) <= bound * 1.01 < 1.04 * bound < best_fit(lengths)


@pytest.mark.parametrize("shape", [lambda r: r.randint(1, 40), lambda r: min(1023, 1 + int(r.expovariate(1 / 300))), lambda r: r.choice([1, 300, 341, 342, 512, 513, 1000]), lambda r: 500, lambda r: r.randint(1, 1023)])
def test_never_worse_than_best_fit(shape):
    rng = random.Random(5)
    lengths = [shape(rng) for _ in range(1500)]
    assert len(packing.evolve(lengths, 1024, 1, [], []).bins) <= best_fit(lengths)


def test_filling_takes_what_is_in_stock():
    rng = random.Random(6)
    for _ in range(300):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 30))]
        bins = packing.filled(lengths, range(len(lengths)), 60, rng, rng.random())
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 60 for b in bins)


def test_query(spark, sf_dir, texts):
    rows = queries.op1_pack(spark, sf_dir).collect()
    used, bound = check(rows, texts)
    assert used <= max(bound, best_fit([r.length for r in rows]))


def test_odd_documents(odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check(queries.packed(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert queries.packed(odd_docs).where("piece = 0").count() == odd_docs.count()
    assert queries.packed(no_docs).count() == 0


def test_several_islands_release_and_stay_whole(spark):
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.randrange(1, 1024), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, island=300).collect()
    assert sorted(r.doc_id for r in packed) == list(range(3000))
    fill = defaultdict(int)
    for r in packed:
        fill[r.sequence_id] += r.length
    bound = max(math.ceil(sum(r[3] for r in rows) / 1024), sum(r[3] > 512 for r in rows))  # no two of over half a sequence fit in one
    assert max(fill.values()) <= 1024 and len(fill) <= bound * 1.02


def test_crossover_keeps_injected_bins_and_every_piece():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 600) for _ in range(200)]
    first = packing.Bins(lengths, 1024)
    first.best_fit(range(200))
    second = packing.evolve(lengths, 1024, 5, [], [])
    injected = second.bins[:20]
    child = packing.crossover(first, injected)
    assert all(set(a) <= set(b) for a, b in zip(injected, child.bins, strict=False))
    lengths = [30, 50, 40, 50]
    bins, stock = [[2, 3]], packing.Stock(lengths, [0, 1], 100)
    packing.exchange(bins, 0, stock, packing.Bins(lengths, 100))
    assert bins == [[1, 3]] and stock.own == {30: [0], 40: [2]}
    assert sorted(i for b in child.bins for i in b) == list(range(200)) and max(child.fill) <= 1024


def test_immigrants_use_each_piece_once():
    built = packing.immigrants([5, 5, 7, 9], [[5, 5], [5, 7], [7, 9]])
    assert [sorted([5, 5, 7, 9][i] for i in b) for b in built] == [[5, 5], [7, 9]]


def test_fast_ids_are_the_librarys():
    fast, library = packing.byte_bpe(open(JSON, "rb").read(), open(RANKS, "rb").read(), P.PATTERN), Tokenizer.from_file(JSON)
    rng = random.Random(3)
    alphabet = [*"abcXYZ 'sdltm.,!?09 \n\t²½ßÀéñ×", "<|endoftext|>", "İ", "中", "😀", "\xa0", "\x1c", "\x85", " ", "'ll"]
    for text in ("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(1500)):
        assert fast(text).tolist() == library.encode(text, add_special_tokens=False).ids
