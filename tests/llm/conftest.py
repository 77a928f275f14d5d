import glob

import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def texts():
    """All documents of the smallest tables: (doc_id, text)."""
    (path,) = glob.glob("/root/testdata/sf0.001/documents.parquet")
    t = pq.read_table(path, columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


@pytest.fixture
def frame(spark):
    """Documents with a column that no operator knows, whose name clashes with what they add."""

    def make(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame([(*r, "x") for r in rows], schema + ", n_tokens string")

    return make


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b   c"), (5, "\n\n a \n"), (6, "<s> </s> <0x0A> <unk> <|endoftext|> it's"), (7, "日本語 漢字 テキスト"), (8, "😀😀 x\x00y"),
    (9, "▁▁a ▁"), (10, "aaaa" * 300), (11, "ab" * 700), (12, " " * 77 + "x"), (13, "a \n b\x1c c \u0085 d"), (14, "12345 ² ½ é"), (15, "a  b   c"), (16, "the " * 5000), (16, "the"),
]


@pytest.fixture
def odd():
    return ODD
