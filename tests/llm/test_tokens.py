"""Token counts, BPE and token files against the libraries, on odd and random texts."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewrack.llm import bpe, token_counts, token_files
from tidewrack.llm.common import vocabulary

LETTERS = "ab  \n\t▁<s>é漢字😀  '0129</s>▁thein　\x00\x1c\x85.,;:!?²½ñ́​"


def random_texts(seed, n=3000):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(60))) for _ in range(n)]
    texts += ["".join(rng.choice("aeinthr") for _ in range(rng.randrange(300))) for _ in range(300)]
    return [*texts, "ab" * 2000, " " * 2000, "the" * 900 + " " * 33 + "x", "漢字" * 300, "x<|endoftext|> y", "<|endoftext|><|endoftext|>  <|endoftext", " <|startoftext|> "]


def test_counts_are_the_librarys(odd_texts):
    texts = random_texts(1) + [t or "" for _, t in odd_texts]
    path = vocabulary("piece_bpe_32k.model")
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert token_counts.counter(path).count(texts) == want


def test_count_columns(spark, odd_docs):
    rows = {r.doc_id: r for r in token_counts.count_tokens(odd_docs, limit=100).collect()}
    assert (rows[1].n_bytes, rows[1].n_tokens, rows[1].over_limit) == (0, 0, False)
    assert rows[5].over_limit and rows[5].n_bytes == 150_000 and rows[4].source is None
    assert token_counts.count_tokens(odd_docs).count() == odd_docs.count()
    assert token_counts.count_tokens(odd_docs.where("false")).count() == 0


def byte_texts(flat, sizes):
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def test_ids_and_decoding_are_the_librarys(odd_texts):
    texts = random_texts(2) + [t or "" for _, t in odd_texts]
    path = vocabulary("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.codec(path)
    got = byte_texts(*codec.encode(texts))
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(x) for x in got] == texts
    rng = random.Random(3)
    odd = [[rng.randrange(50257) for _ in range(rng.randrange(20))] for _ in range(2000)]
    assert [codec.decode(x) for x in odd] == [library.decode(x, skip_special_tokens=False) for x in odd]


def test_round_trip_of_rows(odd_docs):
    rows = bpe.decode(bpe.encode(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(r.decoded == (r.text or "") for r in rows)
    assert bpe.decode(bpe.encode(odd_docs.where("false"))).count() == 0


def test_word_ids_are_the_librarys():
    texts = random_texts(4)
    path = vocabulary("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert byte_texts(*token_files.library_ids(path)(texts)) == want


def test_word_ids_of_every_letter_below_the_limit():
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    texts = [t for c in letters for t in (c, f"a{c}b", f"{c}stanbul.", f"x{c}{c}")]
    path = vocabulary("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert byte_texts(*token_files.library_ids(path)(texts)) == want


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 40_000])
def test_coder_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 900)
    coder = token_files.Coder(token_files.frequencies(np.bincount(ids)))
    lanes = max(1, n // 100)
    states, places, words = coder.encode(ids, lanes, every=16)
    assert (coder.decode(states, places, words, n, lanes, every=16) == ids).all()
    parts = [coder.decode(states, places, words, n, lanes, every=16, first=k, last=k + 1) for k in range(len(states))]
    assert (np.concatenate(parts) == ids).all()


def test_frequencies_sum_to_the_scale():
    counts = np.zeros(50_000, dtype=np.int64)
    counts[:49_000] = 1
    counts[7] = 10**12
    freq = token_files.frequencies(counts)
    assert freq.sum() == 1 << token_files.SCALE and ((freq > 0) == (counts > 0)).all()


def test_damaged_block_raises():
    coder = token_files.Coder(token_files.frequencies(np.array([0, 3, 5])))
    block = bytearray(token_files.pack(coder, [1, None], [np.array([1, 2, 2]), np.array([1])]))
    assert [d.tolist() for d in token_files.unpack(coder, bytes(block))[1]] == [[1, 2, 2], [1]]
    assert token_files.unpack(coder, bytes(block))[0] == [1, None]
    block[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.unpack(coder, bytes(block))


def test_files_of_odd_rows(odd_docs, odd_texts):
    blocks, freq = token_files.write_token_files(odd_docs)
    rows = token_files.read_token_files(blocks, freq, ids=True).orderBy("start").collect()
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in odd_texts)
    assert [(r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens * 4 == len(r.ids) for r in rows)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert token_files.read_token_files(*token_files.write_token_files(odd_docs.where("false"))).count() == 0
