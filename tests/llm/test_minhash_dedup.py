import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import minhash_dedup as M
from codeloom.llm import queries as Q


def brute(docs, idf, threshold=0.8):
    """Components by all pairs."""
    shingler = M.Shingler()
    d, h, m = shingler([t for _, t in docs])
    w = m * idf[(h & np.uint64(M.FEATURES - 1)).astype(np.int64)].astype(float)
    ends = np.searchsorted(d, np.arange(len(docs) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = docs[i][1], docs[j][1]
            if a is not None and b is not None and find(i) != find(j) and (a == b or M.weighted_jaccard(sets[i], sets[j]) >= threshold):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least.setdefault(find(i), []).append(doc)
    return {doc: min(v) for v in least.values() for doc in v}


def found(df):
    return {r.doc_id: (r.class_id, r.kept) for r in M.near_duplicates(df).collect()}


def near_copies(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([40, 150, 300]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 10])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [400, 3])
def test_against_brute_force(spark, frame, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    docs = near_copies() + [(100, None), (101, None), (102, ""), (103, ""), (104, "!!"), (105, "one two"), (106, "One, two"), (107, "one two three"), (108, "a " * 30000), (109, "a " * 29000)]
    df = frame(docs)
    want = brute(docs, M.idf_table(df))
    assert found(df) == {k: (v, k == v) for k, v in want.items()}
    assert M.near_duplicates(frame([])).count() == 0


def test_op10(spark, texts):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(texts, M.idf_table(df))
    assert {r.doc_id: r.class_id for r in Q.op10_minhash_dedup(spark, "/root/testdata/sf0.001").collect()} == want


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = h[:260], h[40:]
    wa, wb = np.ones(260) * 2, np.ones(260) * 2
    n = 1500
    same = (M.samples(a, wa, np.array([0]), n) == M.samples(b, wb, np.array([0]), n)).mean()
    assert abs(same - 220 / 300) < 0.04
    half = (M.samples(h, np.ones(300), np.array([0]), n) == M.samples(h, np.ones(300) * 2, np.array([0]), n)).mean()
    assert abs(half - 0.5) < 0.05


def test_one_of_each(frame):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x"), (4, None), (None, "x y z"), (1, "a b c d e f")]
    kept = M.one_of_each(frame(docs))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, "a b c d e f"), (3, "x"), (4, None), (None, "x y z")]))


def exact_frequencies(texts):
    """Documents of each shingle, as words, by a plain count; the shingles are hashed one text at a time."""
    count = Counter()
    for t in texts:
        count.update(set(M.Shingler()([t])[1].tolist()))
    return count


@pytest.mark.parametrize("ranges", [1 << 10, 2])
def test_document_frequencies_are_exact(spark, frame, monkeypatch, ranges):
    monkeypatch.setattr(M, "CHUNK", 16)
    monkeypatch.setattr(M, "RANGES", ranges)
    rng = random.Random(7)
    # More shingles than 2^20 slots would hold apart, one that occurs twice in a document, and some of many documents.
    docs = [(i, " ".join(["the same five words here the same five words here"] * (i % 3) + [str(rng.random()) for _ in range(9000)])) for i in range(150)]
    want = exact_frequencies([t for _, t in docs])
    table = M.idf_table(frame(docs))
    h = np.array(list(want), np.uint64)
    n = np.array(list(want.values()))
    assert len(h) > 1_300_000 and n.max() == 100
    assert np.allclose(table[h.astype(np.int64)], np.log(151 / (1 + n)) + 1)


def test_shingles_do_not_depend_on_the_text_before():
    texts = ["", "one two three four five", "!!", "one two three four five six", None, "a b", "", "", "one two three four five six seven"]
    d, h, m = M.Shingler()([t or "" for t in texts])
    # Shingles by a plain slide over the words; a text of fewer than five words is one.
    want = {i: len({tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}) for i, t in enumerate(texts) if (w := (t or "").replace("!", "").split())}
    assert {i: int((d == i).sum()) for i in set(d.tolist())} == want
    sets = {i: set(h[d == i].tolist()) for i in want}
    assert sets[1] < sets[3] < sets[8] and m.min() == 1
    assert all(sets[i] == set(M.Shingler()([texts[i]])[1].tolist()) for i in want)


def test_short_near_copy_after_an_empty_text(frame):
    docs = [(1, ""), (2, "one two three four five"), (3, "!!"), (4, "One, two three FOUR five"), (5, "other words than the ones before")]
    assert {k: v[0] for k, v in found(frame(docs).coalesce(1)).items()} == {1: 1, 2: 2, 3: 3, 4: 2, 5: 5}


def plain_classes(docs, threshold=0.8):
    """Groups by all pairs, with shingles as tuples of words, frequencies by a plain count; (id, smallest id of the group) of each row."""
    words = [None if t is None else re.findall("[^\x00-/:-@\\[-`{-\x7f]+", t.translate({c: c + 32 for c in range(65, 91)})) for _, t in docs]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter() for w in words]
    df = Counter(s for c in sets for s in c)
    weigh = lambda c: {s: n * (math.log((1 + len(docs)) / (1 + df[s])) + 1) for s, n in c.items()}
    sets = [weigh(c) for c in sets]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if docs[i][1] is None or docs[j][1] is None or group[i] == group[j]:
                continue
            low = sum(min(w, b[s]) for s, w in a.items() if s in b)
            high = sum(a.values()) + sum(b.values()) - low
            if docs[i][1] == docs[j][1] or (high and low >= threshold * high):
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, docs, strict=True):
        ids.setdefault(g, []).append(i)
    least = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    return sorted(((i, least[g], i == least[g]) for g, (i, _) in zip(group, docs, strict=True)), key=str)


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 2, "BROADCAST_IDS": 0}])
def test_repeated_and_missing_ids(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(M, k, v)
    rng = random.Random(3)
    long = [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(300)]
    near = long[:150] + ["other"] + long[151:]
    docs = [(1, " ".join(long)), (1, "~~~ ~~~"), (2, " ".join(near)), (1, "zzz yyy xxx www vvv uuu"), (1, "zzz yyy xxx www vvv uuu"), (None, " ".join(long).upper()), (None, "!!"), (None, None), (7, None), (5, "~~~ ~~~"), (9, ""), (9, "")]
    docs += [(None if i % 6 == 0 else i % 11, t) for i, t in near_copies(40, 5)]
    df = spark.createDataFrame([(*d, "x", "x", "x", "x") for d in docs], "doc_id bigint, text string, class_id string, kept string, k1 string, node string")
    assert sorted([tuple(r) for r in M.near_duplicates(df).collect()], key=str) == plain_classes(docs)
    rest = M.one_of_each(df)
    assert rest.columns == df.columns
    kept = [(r.doc_id, r.text) for r in rest.collect()]
    groups = {(i, least) for i, least, _ in plain_classes([d for d in docs if d[1] is not None])}
    assert {i for i, t in kept if t is not None} == {least for _, least in groups} and sum(t is None for _, t in kept) == 2
    assert sorted(plain_classes(kept), key=str) == sorted([(i, i, True) for i, _ in kept], key=str)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(40):
        h = rng.integers(0, 2**63, (50, 100)).astype(np.uint64)
        w = rng.choice([1.0, 2.5, 9.0], (50, 10)).repeat(10, axis=1)  # ten of each weight, so that 8 of 10 shared are 0.8 of the weight
        shared = np.tile(np.arange(10) < 8, 10)
        own = np.tile(np.arange(10) < 9, 10)
        a, b = own, shared | ~own  # both hold what is shared, and each a tenth of its own
        draw = lambda at: M.samples(h[:, at].ravel(), w[:, at].ravel(), np.arange(50) * int(at.sum()), M.BANDS * M.ROWS).reshape(50, M.BANDS, M.ROWS)
        missed += int((~(draw(a) == draw(b)).all(2).any(1)).sum())
    assert missed / 2000 < 0.004  # 0.00077 is expected


def test_no_text_has_words(frame):
    assert found(frame([(1, "!!"), (2, ""), (3, "!!"), (4, "?"), (5, None)])) == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}


def test_copies_in_a_large_group_are_linked(frame):
    rng = random.Random(6)
    word = lambda: f"w{rng.getrandbits(60)}"
    text = lambda: [word() for _ in range(300)]
    base, docs = text(), []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(5, 295, 10), 5 if i else 0):
            copy[at] = word()
        docs.append((i, " ".join(copy)))
    docs += [(i, " ".join(text())) for i in range(150, 450)]
    # 271 of 321 shingles are those of the first text: 0.84 by counts, but below the threshold by weight, since 150 texts have them.
    table = M.idf_table(frame(docs))
    d, h, m = M.Shingler()([docs[0][1], docs[1][1]])
    a, b = ((h[d == k], m[d == k] * table[h[d == k]]) for k in (0, 1))
    assert M.weighted_jaccard(a, b) < 0.79
    assert {k: v[0] for k, v in found(frame(docs)).items()} == {i: 0 if i < 150 else i for i, _ in docs}


def test_samples_by_count_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    h, m, n = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 4, 300), 1500
    a, b = M.samples_by_count(np.append(h[:260], h[40:]), np.append(m[:260], m[40:] + 1), np.array([0, 260]), n)
    assert abs((a == b).mean() - m[40:260].sum() / (m.sum() + 260)) < 0.04
