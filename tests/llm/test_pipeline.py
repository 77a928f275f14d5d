import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import minhash_dedup as M
from codeloom.llm.byte_bpe import byte_bpe
from codeloom.llm.common import materialize
from codeloom.llm.decontaminate import windows, words
from tests.llm.test_minhash_dedup import brute as near_classes


def without_repeats(docs):
    """Step 9 by every window."""
    data = {i: t.encode() for i, t in docs}
    seen, twice = set(), set()
    for x in data.values():
        for i in range(len(x) - corpus_pipeline.REPEAT_BYTES + 1):
            w = x[i : i + corpus_pipeline.REPEAT_BYTES]
            (twice if w in seen else seen).add(w)
    out = []
    for i, x in data.items():
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - corpus_pipeline.REPEAT_BYTES + 1):
            if x[k : k + corpus_pipeline.REPEAT_BYTES] in twice:
                gone[k : k + corpus_pipeline.REPEAT_BYTES] = True
        runs = b"\xff".join(b"".join(x[k : k + 1] for k in range(len(x)) if not gone[k]).split(b"\xff"))
        out.append((i, runs.decode("utf-8", "ignore")))
    return [(i, t) for i, t in out if t]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = sorted((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    classes = near_classes(left, M.idf_table(docs))
    left = without_repeats([(i, t) for i, t in left if classes[i] == i])
    wins = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in windows(words(r.text), 10)}
    clean = [(i, t) for i, t in left if not any(tuple(words(t)[k : k + n]) in wins for n in {len(w) for w in wins} for k in range(len(words(t)) - n + 1))]
    bpe = byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {i: r.ids for i, r in rows.items()} == {i: ids for (i, _), ids in zip(clean, bpe.encode([t for _, t in clean]), strict=True)}
    assert 0 < len(rows) < docs.count()


def test_stages_on_empty_and_odd_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, "s", 0), (-3, "!!!", "en", None, 3)], docs.schema))
    for table in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, table, sf), f"test-{name}")
            assert name == "byte_bpe" or out.columns == docs.columns
            assert out.count() <= table.count()


def test_columns_of_the_input_come_back(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = ["score", "lang_pred", "before", "records", "k1", "node", "class_id", "n_bytes", "row", "count", "id"]
    some = docs.limit(60).union(docs.limit(20)).union(spark.createDataFrame([(0, "another text of an id that is there already, with words of its own", "en", "s", 0), (None, "the " * 40000, "en", "s", 0), (None, None, None, None, None)], docs.schema))
    table = some.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in own})
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = materialize(stage(spark, table, sf), f"test-{name}")
        assert table.columns == [*docs.columns, *own]
        rows = table.collect()
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in own)
        kept[name] = sorted(str(r.doc_id) for r in rows)
    assert kept["minhash_dedup"].count("0") == 2  # the two texts of one id are no copies
    assert len(kept["minhash_dedup"]) - len(set(kept["minhash_dedup"])) == 1


def test_decontamination_goes_by_row(spark):
    sf = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(None, text), (1, text), (1, "a clean text"), (2, "x y z"), (None, "another clean text"), (None, None), (3, text), (3, text + " and more")]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema).withColumn("text_key", F.lit("own"))
    out = corpus_pipeline.benchmark(spark, table, sf)
    assert out.columns == table.columns and {r.text_key for r in out.collect()} == {"own"}
    assert sorted((r.doc_id, r.text) for r in out.where("doc_id is not null").collect()) == [(1, "a clean text"), (2, "x y z")]
    assert sorted(str(r.text) for r in out.where("doc_id is null").collect()) == ["None", "another clean text"]
