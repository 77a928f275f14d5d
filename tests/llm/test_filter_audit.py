import re
from itertools import permutations

from codeloom.llm import queries as Q
from codeloom.llm.filter_audit import MEASURES, audit, edges, failures, paths
from tests.oracle import connect, same_rows

SF = "/root/testdata/sf0.001"


def by_hand(docs, labels):
    """Every order and step, one document after another."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    rows = [(i, t or "", lang or "") for i, t, lang in docs]
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t] = min(i, low.get(t, i))
    parts = {}
    for i, t, lang in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low[t]}
        parts.setdefault(lang, []).append((i, {f for f, x in fails.items() if x}))
    out = {}
    for part, members in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                removed = [i for i, x in members if not x & before and f in x]
                kept = sum(not x & (before | {f}) for _, x in members)
                shapley[f] += len(removed)
                out[part, "".join(order), k + 1] = [kept, len(removed), sum(f in x and bool(x & before) for _, x in members), sum(x == {f} for _, x in members), sum(i in good for i in removed), sum(i in toxic for i in removed), f]
        for key, row in out.items():
            if key[0] == part:
                row[6] = shapley[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in (*MEASURES, "shapley")) for r in df.collect()}


def test_lattice(spark):
    steps = paths(spark).collect()
    assert len(steps) == 600 and len({(r.applied, r.filter) for r in steps}) == 80 and len({r.filter_order for r in steps}) == 120


def test_odd_rows(spark):
    varied = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b\x0c\r", None), (4, varied, "en"), (5, varied, "de"), (6, varied, None), (7, varied + " #", "en"), (8, "A" * 30, "en"), (9, "A B", "de"), (10, "x " * 200, "de"),
        (11, "x " * 200, "de"), (4, varied, "en"), (4, "other", "en"), (None, varied, "en"), (None, varied, "en"), (None, None, None), (12, "Éa" + "b" * 9, "fr"), (13, "AaaaaaaaaA" * 10, "fr"), (14, "Aaaaaaaaaa", "fr"),
        (15, " " + varied + " ", "en"), (16, " ".join(f"w{i}" for i in range(80)) + " w1" * 20, "en"), (17, " ".join(f"w{i}" for i in range(79)) + " w1" * 21, "en"), (18, "😀 | 漢", "ja"), (19, "a" * 100_000 + "%", "ja"), (-3, "x " * 200, "ja"),
    ]
    labels = [(4, 1, 0), (4, 0, 1), (5, None, 1), (7, 1, None), (None, 1, 1), (10, 1, 1), (11, 2, 1), (99, 1, 1), (8, 1, 0)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, lang string, fails string, n int").repartition(3)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert found(audit(frame, marks)) == by_hand(docs, labels)
    assert audit(frame.limit(0), marks).count() == 0
    assert found(audit(frame, marks.limit(0))) == by_hand(docs, [])


def test_many_copies_of_one_text_without_ids_and_of_one_id(spark):
    docs = [(i, "the same", "en") for i in range(3000)] + [(None, "the same", "en")] * 500 + [(1, "the same", "de")] * 500
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(0, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert found(audit(frame, labels)) == by_hand(docs, [(0, 1, 1), (5, 1, 0)])
    assert edges(failures(frame, labels)).count() == 160


def test_op13(spark):
    df = Q.op13_filter_audit(spark, SF)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(df) == by_hand(docs, labels)
    same_rows(df, connect(SF), Q.oracle_sql()["op13_filter_audit"])
