import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from codeloom.llm import queries as Q
from codeloom.llm.packing import Complements, Places, best_fit, exact, pack, plan, sequences

WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def used(patterns):
    out = Counter()
    for times, content in patterns:
        for x, n in content.items():
            out[x] += n * times
    return dict(out)


def best_fit_by_hand(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= x]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def some_counts(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 60, 200])
    lengths = [min(capacity, max(1, int(rng.choice([rng.uniform(1, capacity), rng.expovariate(5 / capacity), capacity / 2])))) for _ in range(rng.choice([0, 1, 5, 40, 400]))]
    return lengths, capacity


@pytest.mark.parametrize("seed", range(60))
def test_plans_use_every_length_once_and_few_sequences(seed):
    lengths, capacity = some_counts(seed)
    counts = dict(Counter(lengths))
    patterns = plan(counts, capacity)
    assert used(patterns) == counts
    assert all(t > 0 and sum(x * n for x, n in c.items()) <= capacity for t, c in patterns)
    n = sum(t for t, _ in patterns)
    assert -(-sum(lengths) // capacity) <= n <= best_fit_by_hand(lengths, capacity) + 1


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_of_alike_sequences_is_best_fit(seed):
    lengths, capacity = some_counts(seed)
    patterns = list(best_fit(dict(Counter(lengths)), capacity))
    assert used(patterns) == dict(Counter(lengths))
    assert sum(t for t, _ in patterns) == best_fit_by_hand(lengths, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_gaps_are_filled_if_one_two_or_three_lengths_can(seed):
    rng = random.Random(seed)
    capacity = 40
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
    index = Complements(dict(Counter(lengths)), capacity)
    for gone in range(3):
        for gap in range(1, capacity + 1):
            found = index.fill(gap)
            left = list(index.left.elements())
            can = any(sum(c) == gap for k in (1, 2, 3) for c in combos(left, k))
            assert (found is not None) == can
            if found:
                assert sum(found) == gap and not Counter(found) - Counter(left)
        if index.left:
            index.take(rng.choice(list(index.left)), 1)


def combos(items, k):
    from itertools import combinations

    return combinations(items, k)


def test_exact_patterns_leave_no_gap():
    index = Complements({3: 5, 4: 7, 5: 2, 9: 3, 10: 2, 1: 4}, 10)
    patterns = list(exact(index))
    assert patterns and all(sum(x * n for x, n in c.items()) == 10 for _, c in patterns)


def test_plan_is_bounded_by_the_capacity_not_by_the_counts():
    counts = {x: 10**9 + 7919 * x for x in range(1, 513)}
    patterns = plan(counts, 512)
    assert used(patterns) == counts and len(patterns) < 4 * 512
    longer = sum(n for x, n in counts.items() if x > 256)  # no two of these go together
    assert sum(t for t, _ in patterns) == longer + -(-counts[256] // 2)


def test_places_of_ranks():
    counts = {3: 5, 4: 7, 5: 2, 9: 3, 10: 2, 1: 4}
    places = Places(counts, 10)
    spans = defaultdict(list)
    for length, n in counts.items():
        for s, o in zip(*places.of(np.full(n, length), np.arange(n)), strict=True):
            spans[s].append((o, length))
    assert len(spans) == places.sequences
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 10


def whole(rows, want, capacity):
    """rows of pack() hold the documents of want, (id, ids with the end), in gapless sequences."""
    docs, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        filled[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for doc, ids in want:
        expected[doc] += [(k, at, len(ids[at : at + capacity]), crc(ids[at : at + capacity])) for k, at in enumerate(range(0, len(ids), capacity))]
    assert {d: sorted(p) for d, p in docs.items()} == {d: sorted(p) for d, p in expected.items()}
    for parts in filled.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= capacity
    return len(filled)


def test_op12(spark, library, texts):
    rows = Q.op12_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    want = [(doc, [*library.encode(text or "", add_special_tokens=False).ids, 1]) for doc, text in texts]
    n = whole(rows, want, 4096)
    assert n <= -(-sum(len(ids) for _, ids in want) // 4096) + 1


def test_odd_rows(spark, frame, library, odd):
    more = odd + [(None, "no id"), (None, None), (30, "y<|endoftext|> z <|startoftext|>"), (31, "ÀÉ İstanbul ΣΑΣ é ́x"), (32, "it's we'll 42")] + [(40, "same")] * 300
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 9]) for i, t in more]
    packed = pack(frame(more).repartition(3), WORDS, end_id=9, capacity=50)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    rows = packed.collect()
    whole(rows, want, 50)
    assert sorted(r.ids for r in rows) == sorted(ids[k : k + 50] for _, ids in want for k in range(0, len(ids), 50))
    made = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in rows:
        s = made[r.sequence_id]
        assert s.ids[r.offset : r.offset + r.length] == r.ids and (r.doc_id, r.piece, r.offset) in [tuple(b) for b in s.bounds]
    assert sum(len(s.ids) for s in made.values()) == sum(len(ids) for _, ids in want)
    empty = pack(frame([]), WORDS, end_id=1)
    assert empty.count() == 0 and sequences(empty).count() == 0
