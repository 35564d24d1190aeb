import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuslab.llm import packing

from .conftest import prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizers_library():
    r = random.Random(1)
    alphabet = "ab é\n\t '<|endoftext|>st123.,!   \x1c　日"
    texts = ["", " ", "  ", "a  b", "don't  stop", "x\n y", "<|endoftext|>"]
    texts += ["x" * 30_000, prose("fr", 3000, 1), "日本語" * 500, " " * 5000 + "\n" * 300]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400)]
    for t, ids in zip(texts, packing.token_ids(texts, PATH)):
        assert ids.tolist() == whole(t)


def test_cut():
    assert list(packing.cut(5, 8)) == [(0, 5)]
    assert list(packing.cut(8, 8)) == [(0, 8)]
    assert list(packing.cut(19, 8)) == [(0, 3), (3, 8), (11, 8)]


def test_best_fit_takes_the_fullest_bin_and_closes_it_first():
    b = packing.Bins(10, 2)
    assert b.place(4) == (0, 0)
    assert b.place(7) == (1, 0)
    assert b.place(3) == (1, 7)  # exactly full
    assert b.place(8) == (2, 0)
    assert b.place(9) == (3, 0)  # closes bin 2, the fullest
    assert b.place(1) == (3, 9)
    assert b.place(6) == (0, 4)


def test_packing(odd_docs):
    docs = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    rows = packing.pack(odd_docs, PATH, capacity=64, end_id=2, open_bins=16, group_pieces=200).collect()
    places = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= 64
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["piece"]].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = 0
    for doc_id, text in docs:
        if doc_id is None or doc_id == 7:
            continue
        ids = np.array(whole(text) + [2], dtype="<u4")
        total += len(ids)
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            (r,) = by_doc[doc_id, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, n, zlib.crc32(ids[s:s + n].tobytes()))
    assert len(by_doc[7, 0]) == 3  # repeated rows
    assert len(places) <= 1.1 * sum(r["length"] for r in rows) / 64 + 8
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0
    again = packing.pack(odd_docs, PATH, capacity=64, end_id=2, open_bins=16, group_pieces=200).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_special_tokens_in_texts_are_those_of_the_library_by_default(make_docs):
    t = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n <|endoftext|>y", "<|endoftext| >",
             " ".join(["word <|endoftext|>"] * 100)]
    rows = packing.pack(make_docs([(i, x, "en", "s") for i, x in enumerate(texts)]), PATH, capacity=64, end_id=2).collect()
    by_piece = {(r["doc_id"], r["piece"]): r for r in rows}
    n = 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (s, length) in enumerate(packing.cut(len(ids), 64)):
            r = by_piece[i, k]
            assert (r["start"], r["length"], r["ids_crc32"]) == (s, length, zlib.crc32(ids[s:s + length].tobytes()))
            n += 1
    assert n == len(rows)
    assert 50256 in t.encode(texts[0], add_special_tokens=False).ids
