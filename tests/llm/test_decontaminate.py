import hashlib
import random

import pytest

from codeloom.llm import queries as Q
from codeloom.llm.decontaminate import contamination, find_windows, windows, words


def brute(docs, items, size=10):
    """Every window at every place."""
    wins = [(str(i), w) for i, t in items if i is not None for w in set(windows(words(t), size))]
    out = {}
    for k, (doc, text) in enumerate(docs):
        tokens, hit, names = words(text), set(), set()
        for name, w in wins:
            for s in range(len(tokens) - len(w) + 1):
                if tuple(tokens[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    names.add(name)
        out[k] = (doc, len(tokens), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return sorted(map(str, out.values()))


def rows(df):
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


def test_op3(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    found = rows(Q.op3_decontamination(spark, "/root/testdata/sf0.001"))
    assert found == brute(texts, items)
    assert any("True" in r for r in found)


@pytest.mark.parametrize("set_words", [500_000, 2])
def test_odd_rows(spark, odd, set_words):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "É", "the", "x1"])
    docs = odd + [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(100, "a b c")]
    items = [(1, None), (2, ""), (3, "!!"), (4, "The"), (5, "a B c"), (6, "the the the the the the the the the the the"), (None, "a"), (7, "a B c")] + [(10 + i, " ".join(word() for _ in range(rng.randint(2, 13)))) for i in range(25)]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, spans string")
    df = spark.createDataFrame([(*d, *"xxxxx") for d in docs], "doc_id bigint, text string, n_words string, n_hit string, row string, id string, word string")
    assert rows(contamination(df, benchmark, set_words=set_words)) == brute(docs, items)
    assert contamination(df.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in contamination(df, benchmark.limit(0)).collect())


def test_text_is_kept(frame, spark):
    items = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    (r,) = find_windows(frame([(1, "a x y b X-y")]), items, keep_text=True).collect()
    assert [(s.start, s.end) for s in r.spans] == [(1, 3), (4, 6)] and r.text == "a x y b X-y"
