import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from codeloom.llm import queries as Q
from codeloom.llm import token_files
from codeloom.llm.byte_bpe import encode_decode, read_ranks
from codeloom.llm.token_counts import count_tokens, ragged_bpe
from codeloom.llm.token_files import read_dictionary, read_documents, read_token_files, write_token_files

PIECES, RANKS, JSON = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def made_up(n, letters="abcdeé漢 \n▁Tth.,1=_-' \t", seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_counts_of_made_up_texts(pieces, odd):
    texts = made_up(1500) + made_up(200, "ab") + made_up(200, "  a") + [t or "" for _, t in odd]
    assert ragged_bpe(PIECES).count(texts) == [len(x) for x in pieces.encode(texts)]


def test_op1(spark, pieces, texts):
    rows = {r.doc_id: r for r in Q.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(texts)
    for doc, text in texts:
        n = len(pieces.encode(text or ""))
        assert (rows[doc].n_bytes, rows[doc].n_tokens, rows[doc].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_op1_odd_rows(frame, pieces, odd):
    rows = count_tokens(frame(odd), PIECES, limit=2).collect()
    assert sorted((r.doc_id, r.n_tokens, r.over_limit) for r in rows) == sorted((i, n := len(pieces.encode(t or "")), n > 2) for i, t in odd)
    assert count_tokens(frame([]), PIECES).count() == 0


def test_op5(spark, tik, texts):
    rows = {r.doc_id: r for r in Q.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(texts)
    for doc, text in texts:
        ids = tik.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (rows[doc].n_tokens, rows[doc].ids_sha256, rows[doc].decoded_sha256) == want


def test_op5_odd_rows(frame, tik, odd):
    more = odd + [(100 + i, t) for i, t in enumerate(made_up(400, "abcé漢 \n 　\x0b\x1cTth.,1'st "))]
    rows = encode_decode(frame(more), RANKS, P.PATTERN, outputs=("ids", "decoded")).collect()
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in rows) == sorted((i, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in more)
    assert encode_decode(frame([]), RANKS, P.PATTERN).count() == 0


def test_ranks_file():
    with open(RANKS, "rb") as f:
        token, rank = f.readline().split()
    assert read_ranks(RANKS)[base64.b64decode(token)] == int(rank)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op8(spark, library, texts):
    rows = {r.doc_id: r for r in Q.op8_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for doc, text in sorted(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(texts)


def test_op8_odd_rows(spark, frame, library, odd, tmp_path):
    more = odd + [(None, "no id"), (100, "y<|endoftext|> z")] + [(200 + i, t) for i, t in enumerate(made_up(300))]
    write_token_files(frame(more), f"file://{tmp_path}/a", JSON)
    rows = read_token_files(spark, f"file://{tmp_path}/a").collect()
    want, start = [], 0
    for doc, text in sorted(((d, t or "") for d, t in more), key=lambda x: (x[0] is not None, x[0], x[1])):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), ids))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in rows), key=lambda x: x[1]) == want
    content, width = read_dictionary(spark, f"file://{tmp_path}/a")
    assert content and width == 2
    write_token_files(frame([]), f"file://{tmp_path}/b", JSON)
    assert read_token_files(spark, f"file://{tmp_path}/b").count() == 0


def test_one_document_by_its_offset(spark, frame, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 200)
    docs = [(i, t) for i, t in enumerate(made_up(200))] + [(7, "seven again"), (None, "no id"), (500, "x" * 30_000), (501, None)]
    path = f"file://{tmp_path}/c"
    write_token_files(frame(docs), path, JSON)
    assert spark.read.parquet(f"{path}/blocks").count() > 10
    want = sorted((i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in docs if i in (7, 90, 500, 501))
    found = read_documents(spark, path, [501, 7, 90, 500, 9999])
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == want and all(r.n_tokens == len(r.ids) for r in found.collect())
    assert read_documents(spark, path, []).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(high,7)" in plan and "LessThanOrEqual(low,9999)" in plan
