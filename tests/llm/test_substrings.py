import random
from collections import Counter

import numpy as np
import pytest

from corpuslab.llm import substrings as ss


def brute(rows, window):
    """(doc_id, words, removed, kept text) by counting every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j:j + window]) for _, w in words for j in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone[j:j + window] = [True] * window
        stay = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        out.append((i, len(w), sum(gone), stay))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "k", "n", "c", "x") for i, t in rows],
                                 "doc_id long, text string, kept string, n string, chunk string, `a.b` string").repartition(parts)


def corpus(r, n, vocabulary, length):
    """Documents over few words with shared passages, copies and periodic text."""
    pick = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [pick(r.randrange(5, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [pick(r.randrange(length))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(passages), pick(r.randrange(10))]
        rows.append((i, r.choice([" ", "\n", " \t\x0b "]).join(parts)))
    rows += [(n, rows[0][1]), (n + 1, " ".join(["a"] * 90)), (n + 2, "a b c " * 40), (n + 3, "b c a " * 40),
             (n + 4, None), (n + 5, ""), (n + 6, " \n"), (n + 7, "  é"), (None, rows[1][1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize("window,minimisers,most,chunk", [
    (12, (3, 7), 10 ** 6, 1 << 20), (12, (3, 7), 3, 300), (35, (6, 20), 5, 2000), (35, (6, 20), 10 ** 6, 1), (4, (6, 20), 4, 500)])
def test_removal_equals_brute_force(spark, window, minimisers, most, chunk):
    """One round and all rounds, one chunk a document and many."""
    r = random.Random(window + most)
    for vocabulary in (["a", "b", "c"], [f"w{i}" for i in range(300)]):
        rows = corpus(r, 60, vocabulary, 80)
        assert found(ss.remove_repeats(frame(spark, rows), window, minimisers, most, chunk)) == brute(rows, window)


def test_slices_of_a_long_text(spark, monkeypatch):
    """A long text is worked on in slices; a passage lies across their border."""
    r = random.Random(4)
    words = [f"w{r.randrange(10 ** 6)}" for _ in range(3000)]
    words[2000:2100] = words[90:190]
    for size in (100, 128, 1 << 18):
        monkeypatch.setattr(ss, "SLICE_WORDS", size)
        data = ss.Words([" ".join(words).encode().split()], {})
        first, last, key = ss.super_kmers(data, 35, 6)
        assert [x for f, l in zip(first, last) for x in range(f, l + 1)] == list(range(3000 - 34))
    rows = [(1, " ".join(words)), (2, " ".join(words[500:560]))]
    assert found(ss.remove_repeats(frame(spark, rows))) == brute(rows, 35)


def test_equal_windows_share_key_and_place():
    r = random.Random(6)
    a = [r.choice("xyz") * r.randrange(1, 4) for _ in range(400)]
    a = [x.encode() for x in a]
    words = ss.Words([a, a[37:300]], {b"x": 1, b"yy": 0xFF00, b"z": 0x00FF})
    first, last, key = ss.super_kmers(words, 10, 3)
    of = {x: k for f, l, k in zip(first, last, key) for x in range(f, l + 1)}
    assert all(of[37 + i] == of[400 + i] for i in range(300 - 37 - 9))


def test_first_minimum():
    r = np.random.default_rng(3)
    h = r.integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 3, 5, 8, 30):
        assert ss.first_minimum(h, w).tolist() == [i + int(h[i:i + w].argmin()) for i in range(200 - w + 1)]


def test_codes_of_words():
    """With and without words that have no code; a code is found again."""
    lines = [[b"a", b"long-word", b"\xff\xff", b"b"], [], [b"b", b"a"]]
    words = ss.Words(lines, {b"a": 0xFFFE, b"b": 0})
    assert words.docs.tolist() == [0, 0, 0, 0, 2, 2] and len(words) == 6
    codes = [words.code[a:b] for a, b in zip(words.starts, words.ends)]
    assert codes[0] == codes[5] and codes[3] == codes[4] and len(set(codes)) == 4
    assert ss.code_ends(words.code, 6).tolist() == words.ends.tolist()
    again = ss.Words.of_strings([words.code[:int(words.ends[3])], words.code[int(words.ends[3]):]], [4, 2])
    assert again.ends.tolist() == words.ends.tolist() and again.docs.tolist() == [0, 0, 0, 0, 1, 1]


def test_the_vocabulary_changes_nothing(spark, monkeypatch):
    r = random.Random(9)
    rows = corpus(r, 300, [f"word{i}" for i in range(2000)], 900)
    want = brute(rows, 35)
    for known in (ss.vocabulary, lambda table: [], lambda table: [b"word7", b"word9"]):
        monkeypatch.setattr(ss, "vocabulary", known)
        assert found(ss.remove_repeats(frame(spark, rows), most=20)) == want


def test_no_rows(spark):
    assert found(ss.remove_repeats(frame(spark, []))) == []
    only_empty = [(1, None), (2, "")]
    assert found(ss.remove_repeats(frame(spark, only_empty))) == [(1, 0, 0, ""), (2, 0, 0, "")]
