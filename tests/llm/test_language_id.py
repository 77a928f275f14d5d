import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.llm import queries as Q
from codeloom.llm.language_id import ALPHA, EVIDENCE, LONGEST, fit, identify, predict


def test_op4_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = Q.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoilt = d.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, "xx").otherwise(F.col("lang")))
    assert sorted(identify(d).collect()) == sorted(identify(spoilt).collect())


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en", "s") for i in range(30)] + [(100 + i, "der hund und die katze sind nicht im haus", "de", "s") for i in range(30)] + [(200, None, "en", "s"), (201, "", "en", "s"), (202, "123 !!", None, "s"), (203, "漢字", None, "s"), (204, "zzzqqq", None, "s"), (205, "der " * 50000, None, "s"), (None, "the", "en", "s"), (203, "漢字", None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    found = identify(df).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and by[200].score == 0
    assert by[203].lang_pred in ("de", "en") and by[204].lang_pred in ("de", "en") and by[205].lang_pred == "de" and not by[None].held_out
    kept = predict(df, fit(df), keep_columns=True, names=("found", "how_sure"))
    assert kept.columns == ["doc_id", "text", "lang", "score", "found", "how_sure"] and {r.score for r in kept.collect()} == {"s"}
    with pytest.raises(ValueError):
        predict(df, fit(df), keep_columns=True)
    assert identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in predict(df, fit(df.limit(0))).collect()} == {"und"}


def plain_scores(train, texts):
    """Words first, then n-grams of the words that training has not, by dictionaries and one word at a time."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    parts = lambda w, n: list(w) if n == 1 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    langs = sorted({k for k, _ in train})
    counts = [{k: Counter() for k in langs} for _ in range(LONGEST + 1)]
    for k, t in train:
        for w in letters(t):
            counts[0][k][w] += 1
            for n in range(1, LONGEST + 1):
                counts[n][k].update(parts(w, n))
    known = [set().union(*c.values()) for c in counts]
    log = lambda n, k, g: math.log(counts[n][k][g] + ALPHA) - math.log(sum(counts[n][k].values()) + ALPHA * len(known[n]))
    out = []
    for t in texts:
        total, used, words = dict.fromkeys(langs, 0.0), 0, letters(t or "")
        for w in words:
            if w in known[0]:
                n, found = 0, [w]
            else:
                n = next((n for n in range(LONGEST, 0, -1) if any(g in known[n] for g in parts(w, n))), 0)
                found = [g for g in parts(w, n) if g in known[n]] if n else []
            used += bool(found)
            for k in langs:
                total[k] += sum(log(n, k, g) for g in found) / max(1, len(found))
        if not words:
            out.append(("und", 0.0))
            continue
        best = max(langs, key=lambda k: (total[k], -langs.index(k)))
        share = min(1.0, EVIDENCE / max(used, 1))
        out.append((best, 1 / sum(math.exp((total[k] - total[best]) * share) for k in langs)))
    return out


def test_against_plain_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    asked = [r.text for r in rows] + ["½ ² Ⅸ", "① 〇", "zqxv wkyj", "Zw\u00f6lf b\u00e4ume", "漢字 仮名", "", None, "the the the", "der the", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(df, fit(docs, sample_docs=10**9)).collect()}
    want = plain_scores(train, asked)
    assert [got[i][0] for i in range(len(asked))] == [k for k, _ in want]
    assert max(abs(got[i][1] - s) for i, (_, s) in enumerate(want)) < 1e-3
    assert want[len(rows)] == want[len(rows) + 1] == ("und", 0.0)


def test_equal_scores_and_repeated_rows(spark):
    rows = [(i, "same words here", "bb" if i % 2 else "aa") for i in (0, 2, 3, 5, 6, 8, 9, 11) for _ in range(2)] + [(0, "same words here", "aa")] * 3
    even = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    n = min(sum(r[2] == k for r in even) for k in ("aa", "bb"))
    balanced = [r for k in ("aa", "bb") for r in [x for x in even if x[2] == k][:n]]
    df = spark.createDataFrame(balanced, "doc_id bigint, text string, lang string")
    found = identify(df).collect()
    assert len(found) == len(balanced) and {(r.lang_pred, r.score) for r in found} == {("aa", 0.5)}
