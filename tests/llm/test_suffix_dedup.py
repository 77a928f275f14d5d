import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import queries as Q
from codeloom.llm import suffix_dedup as S


def brute(docs):
    """Every window of every text."""
    data = [(t or "").encode() for _, t in docs]
    count = Counter(x[i : i + S.LENGTH] for x in data for i in range(len(x) - S.LENGTH + 1))
    out = []
    for (doc, _), x in zip(docs, data, strict=True):
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - S.LENGTH + 1):
            if count[x[i : i + S.LENGTH]] > 1:
                gone[i] += 1
                gone[i + S.LENGTH] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if len(x) else np.zeros(0, bool)
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        out.append(str((doc, len(x), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())))
    return sorted(out)


def passages_of(docs, words=50):
    """Runs of more than so many words that strings of SHORT bytes cover which occur twice, by row."""
    data = [(t or "").encode() for _, t in docs]
    count = Counter(x[i : i + S.SHORT] for x in data for i in range(len(x) - S.SHORT + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - S.SHORT + 1):
            if count[x[i : i + S.SHORT]] > 1:
                gone[i : i + S.SHORT] = True
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append(sum(len(x[a:b].split()) > words for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True)))
    return out


def rows(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def passages(n=80, seed=4):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    shared = [text(k) for k in (390, 399, 400, 401, 450, 700, 1500)]
    return [(i, "".join(rng.choice([text(rng.choice([0, 1, 5, 50, 300])), rng.choice(shared), rng.choice(shared)[: rng.choice([380, 410, 1400])], rng.choice(shared)[-rng.choice([401, 430]) :]]) for _ in range(rng.randint(0, 5)))) for i in range(n)]


@pytest.mark.parametrize("segment", [4 << 20, 700])
def test_against_brute_force(frame, monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    docs = passages() + [(200, None), (201, ""), (202, "a" * 900), (203, "ab" * 450), (204, "x" * 400), (205, "y" * 399), (206, "y" * 399), (207, "é" * 200), (None, "q" * 401), (208, "same " * 100), (208, "same " * 100), (209, "w" * 400 + "v" * 400)]
    assert rows(S.remove_repeats(frame(docs))) == brute(docs)
    assert S.remove_repeats(frame([])).count() == 0


def test_op9(spark, texts):
    found = rows(Q.op9_suffix_dedup(spark, "/root/testdata/sf0.001"))
    assert found == brute(texts) and sum(int(r.split(", ")[2]) for r in found) > 0


def crowded(n=60, seed=8):
    """One passage in many surroundings, and others beside it."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    hot, cold = text(110), [text(60) for _ in range(4)]
    return [(None if i % 5 == 0 else i % 7, " ".join([text(rng.randint(0, 30)), hot if i % 3 else rng.choice(cold), text(rng.randint(0, 30)), *([rng.choice(cold)] if i % 4 == 0 else [])])) for i in range(n)] + [(3, "x" * 500), (3, "y" * 100), (None, hot), (None, hot)]


@pytest.mark.parametrize("settings", [{}, {"CROWD": 1, "FLUSH": 2000}, {"HOT_BYTES": 1, "HOT_TEXTS": 1, "TASKS": 2}, {"HOT_BYTES": 1, "HOT_TEXTS": 10, "TEXTS": 40, "BUCKET_BYTES": 3000, "MERGE_TEXTS": 30, "BROADCAST_BYTES": 1}])
def test_crowded_cores_and_passages(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(S, k, v)
    docs = crowded() + passages(30)
    df = spark.createDataFrame([(*d, "x", "x", "x") for d in docs], "doc_id bigint, text string, k1 string, n_bytes string, records string")
    found = S.remove_repeats(df, passage_words=50).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == brute(docs)
    assert sorted((r.n_bytes, r.n_passages) for r in found) == sorted((len(t.encode()), p) for (_, t), p in zip(docs, passages_of(docs), strict=True))
    kept = S.remove_repeats(df, keep_columns=True, length=200)
    assert kept.columns == df.columns and kept.count() == len(docs)


def test_a_lower_length(frame, monkeypatch):
    docs = passages(60, seed=9)
    found = rows(S.remove_repeats(frame(docs), length=200))
    monkeypatch.setattr(S, "LENGTH", 200)
    assert found == brute(docs)


def test_rest_of_rows(frame):
    passage = "p" * 150 + "é" * 150
    docs = [(1, "one " + passage + " two"), (2, passage + " three"), (3, None), (4, "é" + "z" * 10)]
    kept = S.remove_repeats(frame(docs), keep_columns=True)
    assert kept.columns == ["doc_id", "text", "n_tokens"]
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "one wo", 2: "hree", 3: None, 4: "ézzzzzzzzzz"}  # " t" is shared too


def test_merged_transforms_are_in_suffix_order():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 4, rng.integers(1, 12)).tolist() for _ in range(60)]
    transforms, labels = [], []
    for k in range(4):
        own = texts[k::4]
        symbols = np.array([s for t in own for s in [*t, 0]], np.uint16)
        starts = np.concatenate(([True], symbols[:-1] == 0))
        order = S.suffix_order(symbols, 12)
        before = np.roll(symbols, 1)
        before[starts] = 0
        transforms.append(before[order])
        labels += [tuple(symbols[i : i + 1 + np.flatnonzero(symbols[i:] == 0)[0]].tolist()) for i in order]
    where, interval = S.merge_transforms(transforms, 5)
    merged = [labels[i] for i in where]
    assert [m[:5] for m in merged] == sorted(m[:5] for m in merged)
    for a, b, x, y in zip(merged, merged[1:], interval, interval[1:], strict=False):
        assert (x == y) == (a[:5] == b[:5] and 0 not in a[:5])
