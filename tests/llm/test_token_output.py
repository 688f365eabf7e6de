"""Token output: exact round trips through the coder and the files."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.range_coder import BLOCK, decode, encode
from llm.scratch import folder
from llm.token_output import op2_token_output, read_ids, write_ids
from tests.conftest import SF_SMALL

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a b<|endoftext|>c <|ENDOFTEXT|> D", "É́ é ,.. x., x, .", "O'Clock it's IT'S'S, don't.", " a　b\x1cc", "123.45, 1,2. ½ x² ٣",
       "क़ क़a ß ﬁ İ İ ς Σ ΑΣ", "", "  \n", "a" * 5000, "日本語。テキスト, 中文.", "x.\x85y, z", "😀👍🏽,😀. a👍.", "w " * 60_000]


def test_blocks_round_trip():
    r = np.random.default_rng(1)
    blocks = [np.zeros(0, np.uint32), np.array([5], np.uint32), r.integers(0, 2**32, BLOCK, dtype=np.uint64).astype(np.uint32), np.zeros(BLOCK, np.uint32),
              r.integers(0, 3, 777).astype(np.uint32), np.arange(BLOCK, dtype=np.uint32) * 1_000_003, np.full(3, 2**32 - 1, np.uint32),
              (r.zipf(1.3, BLOCK) % 49_408).astype(np.uint32), np.tile(r.integers(0, 49_408, 50), 80)[:BLOCK].astype(np.uint32)]
    coded = encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, decode(coded)))
    assert all((blocks[k] == decode([coded[k]])[0]).all() for k in range(len(blocks)))     # each alone
    assert len(coded[8]) < len(blocks[8]) and len(coded[3]) < 400


def test_a_damaged_block_is_noticed():
    ids = np.arange(3000, dtype=np.uint32) % 97
    coded = bytearray(encode([ids])[0])
    coded[4] ^= 1
    with pytest.raises(ValueError):
        decode([bytes(coded)])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts(spark, name):
    path, t = folder(spark, "ids"), Tokenizer.from_file(public_tokenizers.path(name))
    rows = [(i, s, "x") for i, s in enumerate(ODD)] + [(99, None, "x"), (99, None, "x"), (None, "z", "x")]
    write_ids(spark.createDataFrame(rows, "doc_id long, text string, frame string"), public_tokenizers.path(name), path, 2)
    got = [(r.doc_id, r.ids) for r in read_ids(spark, path).collect()]
    want = [(i, t.encode(s or "", add_special_tokens=False).ids + [2]) for i, s, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_sample_tables(spark):
    t = Tokenizer.from_file(WORD)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    want, at = [], 0
    for i, text in docs:
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op2_token_output(spark, SF_SMALL).collect()) == want


def test_empty_table(spark):
    path = folder(spark, "ids")
    write_ids(spark.createDataFrame([], "doc_id long, text string"), WORD, path)
    assert read_ids(spark, path).count() == 0


def test_remembered_words_are_small():
    import tracemalloc

    from llm.token_output import Words
    words = Words(public_tokenizers.path("word_bpe_49k.json"))
    plain = [f"{(k * 2654435761) % 1000003:x}" for k in range(100_000)]
    data = np.frombuffer(" ".join(plain).encode(), np.uint8)
    parts = np.array_split(np.array(plain), 20)             # learned bit by bit, as slices come
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for part in parts:
        raw = np.frombuffer(" ".join(part.tolist()).encode(), np.uint8)
        words.encode(raw, np.array([0, len(raw)]))
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert held < 60 * 100_000                              # bytes: place, hash, length and a few ids of each
    ids, n = words.encode(data, np.array([0, len(data)]))
    assert n.tolist() == [len(ids)] and ids[:2000].tolist() == words.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids[:2000]


def test_symbols_are_found_by_part_of_the_total():
    from llm.range_coder import _Lanes
    r = np.random.default_rng(7)
    symbols = np.array([1, 2, 700, 33, 1, 4096])
    lanes = _Lanes(6, symbols, search=True)
    assert lanes.two.itemsize == lanes.one.itemsize == 2
    for _ in range(4):
        lanes.renew(6)
        for lane, k in enumerate(symbols.tolist()):
            want = np.append(r.integers(0, int(lanes.total[lane]), 500), [0, int(lanes.total[lane]) - 1])
            found = lanes.find(np.full(502, lane), want) - lanes.at0[lane]
            assert (found == np.searchsorted(lanes.sums[lane, : k + 1], want, side="right") - 1).all()
            np.add.at(lanes.count[lane], (r.zipf(1.2, 300) % k), 32)
