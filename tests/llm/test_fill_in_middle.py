import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import fill_in_middle as fim
from codeloom.llm import queries as Q
from codeloom.llm.fill_in_middle import byte_slices, fill_in_middle, restored
from tests.oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


def by_hand(doc, text, seed="1", marks=fim.MARKS, changed=90, spm=20):
    """(n, form, prefix_chars, middle_chars, output)"""
    text, doc = text or "", "" if doc is None else str(doc)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, hexes = len(units), hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= changed:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


def made(df):
    out = df.withColumn("again", restored(F.col("output"), F.col("form"))).collect()
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out), key=repr)


def test_odd_rows(frame, odd):
    more = odd + [(20, "a<P>b"), (21, "<S>"), (22, "<M"), (23, "x <M> y"), (24, "<<P"), (25, "P>S>M>"), (None, "no id"), (None, None), (-7, "é" * 50), (26, "one\ntwo"), (27, "long " * 200_000)]
    more += [(100 + i, f"some words, {i} of them; and <the rest") for i in range(200)]
    want = sorted(((i, *by_hand(i, t), t or "") for i, t in more), key=repr)
    assert made(fill_in_middle(frame(more))) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fill_in_middle(frame([])).count() == 0


def test_other_parameters(spark):
    rows = [(f"k{i}", "alpha beta gamma " * i) for i in range(60)]
    marks = ("[pre]", "(suf)", "{mid}")
    df = spark.createDataFrame(rows, "key string, body string")
    out = fill_in_middle(df, "key", "body", seed=5, changed_percent=50, spm_percent=60, marks=marks)
    got = sorted((r.key, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == sorted((k, *by_hand(k, t, "5", marks, 50, 60)) for k, t in rows)
    assert sorted(r.t for r in out.select(restored(F.col("output"), F.col("form"), marks).alias("t")).collect()) == sorted(t for _, t in rows)


@pytest.mark.parametrize("marks", [("<P>", "<P>x", "<M>"), ("ab", "bc", "x"), ("aa", "aba", "z"), ("", "b", "c")])
def test_marks_that_cannot_be_told_apart(frame, marks):
    with pytest.raises(ValueError):
        fill_in_middle(frame([]), marks=marks)


def test_slices_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 10)
    texts = ["", None, "a" * 25, "bb", "cc", "d" * 9, "", "e" * 11, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["id", "text"]).slice(1)
    parts = list(byte_slices(batch, 1))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts[1:]
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 10 for p in parts)


def test_op11(spark, texts):
    df = Q.op11_fill_in_middle(spark, SF)
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for doc, text in texts:
        n, form, prefix, middle, output = by_hand(doc, text)
        r = rows[doc]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(text or ""))
    same_rows(df, connect(SF), Q.oracle_sql()["op11_fill_in_middle"])
