from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tests.llm import awkward
from tokenizers import Tokenizer

from corpusmill.llm import bpe, token_counts, token_output
from corpusmill.llm.tokenizing import safe_pieces

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_whole_text_encoding_and_round_trips(spark, plain):
    df = awkward.frame(spark)
    got = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).select("text", "ids", "decoded", "n_words").collect()
    assert len(got) == df.count()
    for r in got:
        assert list(r.ids) == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.n_words == "clash"
    assert bpe.encode(awkward.frame(spark, empty=True), RANKS, P.PATTERN).count() == 0


def test_long_texts_are_cut_only_where_matches_end(plain):
    text = ("word 12  x\n\n y's " * 30000)[:400000] + "z" * 1000
    pieces = safe_pieces(text, 1000)
    assert len(pieces) > 100 and "".join(pieces) == text
    assert sum((plain.encode_ordinary(p) for p in pieces), []) == plain.encode_ordinary(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    df = awkward.frame(spark)
    got = token_counts.count_tokens(df, P.path(name), limit=50).select("text", "n_bytes", "n_tokens", "over_limit").collect()
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=P.path(name)): len(m.encode(t))
    else:
        count = lambda t, m=Tokenizer.from_file(P.path(name)): len(m.encode(t, add_special_tokens=False).ids)
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), count(t), count(t) > 50)
    assert token_counts.count_tokens(awkward.frame(spark, empty=True), P.path(name)).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000, 70000])
def test_segments_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 1000 else 50000, n, dtype=np.uint32)
    data = token_output.pack(ids, planes, block_ids=1 << 12)
    assert (token_output.unpack(data) == ids).all()
    assert len(token_output.blocks(data)) == -(-n // 4096)
    assert (token_output.unpack(data, range(1, 2)) == ids[4096:8192]).all()


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    df = awkward.frame(spark)
    out = str(tmp_path / "tokens")
    token_output.write_tokens(df, WORDS, out, end_id=2, partitions=3)
    got = token_output.read_tokens(spark, out).orderBy("start").collect()
    tok = Tokenizer.from_file(WORDS)
    want = [(r.doc_id, [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in df.collect()]
    want.sort(key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for r, (doc, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
    empty = str(tmp_path / "none")
    token_output.write_tokens(awkward.frame(spark, empty=True), WORDS, empty)
    assert token_output.read_tokens(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_are_counted_in_bounded_groups(spark, name):
    text = "It's café <|endoftext|> ΣΑΣ 42x\r\n\x0b é A9\n " * 12000
    texts = pa.array([text, "", "one", text[:70000]])
    sizes = [sum(map(len, pieces)) for _, pieces in token_counts.groups(texts, cut=True, most=100000)]
    assert len(sizes) > 3 and max(sizes) <= 100000
    rows = [(row, piece) for g in token_counts.groups(texts, cut=True) for row, piece in zip(*g, strict=True)]
    assert ["".join(p for r, p in rows if r == i) for i in range(4)] == texts.to_pylist()
    got = token_counts.count_tokens(spark.createDataFrame([(t,) for t in texts.to_pylist()], "text string"), P.path(name)).select("n_tokens").collect()
    library = Tokenizer.from_file(P.path(name))
    assert [r.n_tokens for r in got] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts.to_pylist()]
