"""Per-segment sufficient statistics as Arrow (pandas) UDFs.

A segment is one (hypothesis, reference) pair. Its statistics are small
integer vectors that add up over segments, so corpus scores, per-group scores
and bootstrap rounds are all plain ``sum`` aggregates afterwards:

* chrF++ (char orders 1..6, word orders 1..2): hyp count, ref count, clipped
  matches -> 24 longs;
* BLEU: hyp_len, ref_len, clipped matches 1..4, totals 1..4 -> 10 longs;
* ROUGE-L: longest common subsequence of the two token lists, bit-parallel
  (Hyyro 2004), with Porter stemming of tokens longer than 3.

The UDFs are a map over segments: no shuffle, memory bounded by one segment.
Inside, the pairs of a batch are counted together with numpy, in chunks of bounded
length: words are numbered once, a metric's tokens come from its distinct words,
and n-grams are packed into int64 keys.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAR_ORDER = 6
WORD_ORDER = 2
BLEU_ORDER = 4
CHUNK_CHARS = 1 << 20   # characters of hypotheses (and of references) that are cut into tokens in one go
COUNT_SYMBOLS = 1 << 16  # symbols of hypotheses whose n-grams are counted in one go (they stay in the cache)
MASK_BYTES = 1 << 22    # bit masks of the hypotheses that meet one reference side by side
GUARD_BITS = 32         # free bits between them, and steps until these are cleared
MEMO_WORDS = 1 << 16    # words whose tokens a task keeps
SLICE_ROWS = 1 << 10    # rows of an Arrow batch that are Python strings at a time


@functools.cache
def keep_freed_memory() -> None:
    """Frees one array of nearly 32 MB, once a process: glibc then keeps freed
    arrays up to that size for the next chunk instead of returning their pages,
    which took a third of the time. At most 64 MB are kept."""
    np.empty((1 << 25) - (1 << 16), dtype=np.uint8)


def _dense_ids(a_tokens, b_tokens):
    """Map the tokens of two sequences onto shared dense ids (C hash table)."""
    na = len(a_tokens)
    both = np.empty(na + len(b_tokens), dtype=object)
    both[:na] = a_tokens
    both[na:] = b_tokens
    if both.size == 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    codes, uniq = pd.factorize(both)
    codes = codes.astype(np.int64)
    return codes[:na], codes[na:], len(uniq)


def _char_ids(a: str, b: str):
    ca = np.frombuffer(a.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    cb = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    both = np.concatenate([ca, cb])
    if both.size == 0:
        return ca, cb, 0
    top = int(both.max())
    if top < 1024:          # code points already pack 6 to an int64
        return ca, cb, top
    uniq, inv = np.unique(both, return_inverse=True)
    inv = inv.astype(np.int64) + 1
    return inv[: ca.size], inv[ca.size:], uniq.size


def _grams(ids: np.ndarray, n: int, bits: int):
    """n-gram ids of an id sequence: packed int64 when they fit, else rows."""
    L = ids.size - n + 1
    if L <= 0:
        return np.empty(0, dtype=np.int64)
    if bits * n <= 62:
        g = np.zeros(L, dtype=np.int64)
        for j in range(n):
            g = (g << bits) | ids[j: j + L]
        return g
    # Too many distinct symbols to pack: compare n-gram rows directly.
    return np.stack([ids[j: j + L] for j in range(n)], axis=1)


def _clipped(h: np.ndarray, r: np.ndarray) -> int:
    if h.shape[0] == 0 or r.shape[0] == 0:
        return 0
    if h.ndim == 1:
        # sort both sides; run-length count the hypothesis grams and look
        # their counts up in the sorted reference by binary search
        hs, rs = np.sort(h), np.sort(r)
        first = np.empty(hs.shape[0], dtype=bool)
        first[0] = True
        np.not_equal(hs[1:], hs[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        uh = hs[starts]
        ch = np.diff(np.append(starts, hs.shape[0]))
        cr = np.searchsorted(rs, uh, "right") - np.searchsorted(rs, uh, "left")
        return int(np.minimum(ch, cr).sum())
    uh, ch = np.unique(h, axis=0, return_counts=True)
    ur, cr = np.unique(r, axis=0, return_counts=True)
    rc = {tuple(row): c for row, c in zip(ur.tolist(), cr.tolist())}
    return int(sum(min(c, rc.get(tuple(row), 0)) for row, c in zip(uh.tolist(), ch.tolist())))


def _run_counts(sorted_keys: np.ndarray):
    """Distinct values and their counts of a sorted array."""
    first = np.empty(sorted_keys.shape[0], dtype=bool)
    first[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    return sorted_keys[starts], np.diff(np.append(starts, sorted_keys.shape[0]))


def _window_keys(ids: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Sorted keys of the length-``width`` windows starting at every position
    (ids >= 1; positions past the end are 0)."""
    pad = np.concatenate([ids, np.zeros(width - 1, dtype=np.int64)])
    key = np.zeros(ids.shape[0], dtype=np.int64)
    for j in range(width):
        key = (key << bits) | pad[j: j + ids.shape[0]]
    return np.sort(key)


def _orders(a: np.ndarray, b: np.ndarray, k: int, orders) -> list[int]:
    """[hyp count, ref count, clipped matches] for each n-gram order.

    Ids are shifted to >= 1 and the longest-order windows of each side are
    sorted once; an order-n gram is the window key shifted right, which keeps
    the order, and is valid when its last symbol is not padding."""
    orders = list(orders)
    top = max(orders)
    bits = max(1, (int(k) + 1).bit_length())
    if bits * top > 62 or a.shape[0] == 0 or b.shape[0] == 0:
        out: list[int] = []
        bits0 = max(1, int(k).bit_length())
        for n in orders:
            ga, gb = _grams(a, n, bits0), _grams(b, n, bits0)
            out += [int(ga.shape[0]), int(gb.shape[0]), _clipped(ga, gb)]
        return out
    ka, kb = _window_keys(a + 1, top, bits), _window_keys(b + 1, top, bits)
    mask = (1 << bits) - 1
    out = []
    for n in orders:
        sh = bits * (top - n)
        ha, hb = ka >> sh, kb >> sh
        ha, hb = ha[(ha & mask) != 0], hb[(hb & mask) != 0]
        if ha.shape[0] == 0 or hb.shape[0] == 0:
            out += [int(ha.shape[0]), int(hb.shape[0]), 0]
            continue
        uh, ch = _run_counts(ha)
        cr = np.searchsorted(hb, uh, "right") - np.searchsorted(hb, uh, "left")
        out += [int(ha.shape[0]), int(hb.shape[0]), int(np.minimum(ch, cr).sum())]
    return out


class Counted:
    """One side of many pairs (a reference): its symbols, and the sorted keys
    of its n-grams of every order, worked out once.

    Symbols of the other side that do not occur here share one id: a gram that
    contains one cannot match, so counts and clipped matches stay exact."""

    def __init__(self, symbols, top: int):
        self.symbols, self.top = symbols, top
        if isinstance(symbols, str):
            codes = _codes(symbols)
            self.known, ids = np.unique(codes, return_inverse=True)
            k = len(self.known)
        else:
            self.known = {}
            ids = np.array([self.known.setdefault(x, len(self.known)) for x in symbols], dtype=np.int64)
            k = len(self.known)
        self.size, self.unknown = len(ids), k
        self.bits = max(1, (k + 2).bit_length())
        self.packs = self.bits * top <= 62
        if self.packs:
            keys, mask = _window_keys(ids.astype(np.int64) + 1, top, self.bits), (1 << self.bits) - 1
            shifted = [keys >> (self.bits * (top - n)) for n in range(1, top + 1)]
            self.orders = [g[(g & mask) != 0] for g in shifted]

    def ids_of(self, symbols) -> np.ndarray:
        if isinstance(symbols, str):
            codes = _codes(symbols)
            at = np.searchsorted(self.known, codes)
            at[at == len(self.known)] = 0
            return np.where(self.known[at] == codes, at, self.unknown) if len(self.known) else np.zeros(len(codes), dtype=np.int64)
        return np.array([self.known.get(x, self.unknown) for x in symbols], dtype=np.int64)

    def against(self, symbols) -> list[int]:
        """[count there, count here, clipped matches] for each order."""
        if not self.packs:  # too many distinct symbols for one key
            a, b, k = (_char_ids if isinstance(symbols, str) else _dense_ids)(symbols, self.symbols)
            return _orders(a, b, k, range(1, self.top + 1))
        n, top, out = len(symbols), self.top, []
        if n == 0 or self.size == 0:
            return [x for o in range(1, top + 1) for x in (max(0, n - o + 1), max(0, self.size - o + 1), 0)]
        keys, mask = _window_keys(self.ids_of(symbols).astype(np.int64) + 1, top, self.bits), (1 << self.bits) - 1
        for o in range(1, top + 1):
            own, here = keys >> (self.bits * (top - o)), self.orders[o - 1]
            own = own[(own & mask) != 0]
            if own.shape[0] == 0 or here.shape[0] == 0:
                out += [int(own.shape[0]), int(here.shape[0]), 0]
                continue
            u, c = _run_counts(own)
            there = np.searchsorted(here, u, "right") - np.searchsorted(here, u, "left")
            out += [int(own.shape[0]), int(here.shape[0]), int(np.minimum(c, there).sum())]
        return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def chrf_segment(h_chars: str, r_chars, h_words, r_words) -> list[int]:
    """24 chrF++ counts; a reference side may be ``Counted`` already."""
    chars = r_chars if isinstance(r_chars, Counted) else Counted(r_chars, CHAR_ORDER)
    words = r_words if isinstance(r_words, Counted) else Counted(r_words, WORD_ORDER)
    return chars.against(h_chars) + words.against(h_words)


def bleu_segment(h_tokens, r_tokens) -> list[int]:
    ref = r_tokens if isinstance(r_tokens, Counted) else Counted(r_tokens, BLEU_ORDER)
    st = ref.against(h_tokens)
    matches = [st[3 * i + 2] for i in range(BLEU_ORDER)]
    totals = [st[3 * i] for i in range(BLEU_ORDER)]
    return [len(h_tokens), ref.size] + matches + totals


def positions(tokens) -> dict:
    """Where every token occurs, as the bits of an integer."""
    found: dict = {}
    for i, x in enumerate(tokens):
        found[x] = found.get(x, 0) | (1 << i)
    return found


def lcs(a, b, masks: dict | None = None) -> int:
    """LCS length, bit-parallel over the positions of ``a`` (``masks``, if they
    are known)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks = positions(a) if masks is None else masks
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v ^ u)) & full   # u's bits are v's: v ^ u is v - u, faster
    return len(a) - v.bit_count()


# ---------------------------------------------------------------- fused pass
def pre_13a(s: str) -> str:
    """The replacements of the 13a tokeniser that come before its rules; they may join words."""
    from corpuslab.functions.tokenize import T13A_PRE

    for a, b in T13A_PRE:
        s = s.replace(a, b)
    return s


def _py_tokenisers():
    """The metric tokenisers (fixed patterns of ``functions.tokenize``), used
    inside the fused statistics UDF so the texts cross into Python once."""
    import re

    from corpuslab.functions.tokenize import CHRF_PUNCT, T13A_RULES

    punct = set(CHRF_PUNCT)
    rules = [(re.compile(p), r.replace("$", "\\")) for p, r in T13A_RULES]
    non_alnum = re.compile(r"[^a-z0-9]+")
    no_token = re.compile(r"[^a-z0-9\n]+")

    def chrf_words(s: str) -> list[str]:
        if s.isalnum():
            return [s]
        out: list[str] = []
        for w in s.split():
            if len(w) > 1 and w[-1] in punct:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in punct:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    def rules_13a(s: str) -> list[str]:
        s = f" {s} "
        for rx, rep in rules:
            s = rx.sub(rep, s)
        return s.split()

    def tok_13a(s: str) -> list[str]:
        return rules_13a(pre_13a(s))

    def rouge_words(s: str) -> list[str]:
        if s.isascii() and s.isalnum():
            return [s.lower()]
        return non_alnum.sub(" ", s.lower()).split()

    def rules_13a_each(words: list[str]) -> list[list[str]]:
        s = " " + " \n ".join(words) + " "
        for rx, rep in rules:
            s = rx.sub(rep, s)
        return [w.split() for w in s.split("\n")]

    def rouge_each(words: list[str]) -> list[list[str]]:
        return [w.split() for w in no_token.sub(" ", "\n".join(words).lower()).split("\n")]

    # the tokens of each of many words (white space is in none of them), a line for every word
    chrf_words.of_words = lambda words: [chrf_words(w) for w in words]
    tok_13a.of_words = rules_13a_each  # words of texts that ``pre_13a`` has gone over
    rouge_words.of_words = rouge_each
    return chrf_words, tok_13a, rouge_words


STATS_TYPE = T.StructType([T.StructField("chrf", T.ArrayType(T.LongType())),
                           T.StructField("bleu", T.ArrayType(T.LongType())),
                           T.StructField("rouge", T.ArrayType(T.LongType()))])


def letters_only(words: pa.Array) -> np.ndarray:
    """Words of letters and digits: no rule of 13a or chrF++ cuts these."""
    return pc.utf8_is_alnum(words).to_numpy(zero_copy_only=False)


def own_stems(words: pa.Array) -> np.ndarray:
    """Words of lower-case letters and digits that ROUGE-L neither cuts nor stems."""
    from corpuslab.functions.porter import ENDINGS

    stays = pc.or_(pc.less_equal(pc.binary_length(words), 3),
                   pc.invert(pc.match_substring_regex(words, f"(?:{'|'.join(ENDINGS)})$")))
    return pc.and_(pc.match_substring_regex(words, "^[a-z0-9]+$"), stays).to_numpy(zero_copy_only=False)


def not_empty(words: pa.Array) -> np.ndarray:
    return pc.not_equal(words, "").to_numpy(zero_copy_only=False)


class ByWord(dict):
    """The tokens of words, worked out once while the words kept number at most
    ``MEMO_WORDS``. The metric tokenisers never look across white space (a rule
    takes the blank before or after a word, and no rule takes both), so a text's
    tokens are those of its words. ``plain`` marks words that are sure to be
    their own only token; these stay in Arrow."""

    def __init__(self, tokens_of_words=None, plain=None):
        super().__init__()
        self.tokens_of_words, self.plain = tokens_of_words, plain

    def each(self, words: list[str]) -> list[tuple]:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = words
        if new:
            self.update(zip(new, map(tuple, self.tokens_of_words(new))))
        return [self[w] for w in words]


#: Tokens that white space parts.
SPACED = ByWord(lambda words: [()] * len(words), not_empty)


class Words:
    """The words of some texts as numbers. Arrow splits at the characters that
    ``str.split`` splits at; white space at an end of a text leaves an empty word,
    which has no tokens."""

    def __init__(self, texts: list[str]):
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        self.words = split.flatten()
        self.stops = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = self.words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = coded.dictionary

    def tokens(self, of: ByWord) -> tuple[np.ndarray, np.ndarray, int]:
        """(token numbers of all texts, tokens of each text, distinct tokens)."""
        plain = of.plain(self.distinct) if of.plain else np.zeros(len(self.distinct), dtype=bool)
        found = of.each(self.distinct.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist())
        n = np.ones(len(plain), dtype=np.int64)
        n[~plain] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        # the plain words are distinct, so their numbers are 0, 1, ...
        cut = pa.array(list(chain.from_iterable(found)), self.distinct.type)
        vocabulary = pa.concat_arrays([self.distinct.filter(pa.array(plain)), cut]).dictionary_encode()
        number, own = vocabulary.indices.to_numpy(zero_copy_only=False), np.repeat(plain, n)
        ids, alone = np.empty(len(own), dtype=np.int64), int(plain.sum())
        ids[own], ids[~own] = number[:alone], number[alone:]
        each = n[self.codes]
        ends = np.cumsum(each)
        at = np.repeat((np.cumsum(n) - n)[self.codes] - (ends - each), each) + np.arange(int(each.sum()))
        upto = np.concatenate([[0], ends])[self.stops]
        return ids[at], np.diff(upto, prepend=0), len(vocabulary.dictionary)

    def chars(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for the code points that are no white space: those of the words, which lie one after another."""
        if len(self.words) == 0 or self.words.buffers()[2] is None:
            return np.empty(0, dtype=np.int64), np.zeros(len(self.stops), dtype=np.int64), 0
        at = np.frombuffer(self.words.buffers()[1], dtype=np.int64)[self.words.offset:self.words.offset + len(self.words) + 1]
        held = np.frombuffer(self.words.buffers()[2], dtype=np.uint8)[at[0]:at[-1]]
        stops = at[self.stops] - at[0]
        if held.size == 0 or int(held.max()) < 128:
            codes = held
        else:
            codes = _codes(held.tobytes().decode("utf-8"))
            stops = np.concatenate([[0], np.cumsum((held & 0xC0) != 0x80)])[stops]
        lens = np.diff(stops, prepend=0)
        if codes.size and int(codes.max()) < 1 << 16:
            there = np.bincount(codes) > 0
            return (np.cumsum(there) - 1)[codes], lens, int(there.sum())
        known, ids = np.unique(codes, return_inverse=True)
        return ids.astype(np.int64), lens, len(known)


def _numbered(tokens) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens, from 0, and the distinct tokens."""
    held = list(tokens)
    both = np.empty(len(held), dtype=object)
    both[:] = held
    codes, distinct = pd.factorize(both)
    return codes.astype(np.int64), distinct


def pair_matches(ids: np.ndarray, lens: np.ndarray, ref_of: np.ndarray, top: int, symbols: int) -> np.ndarray:
    """Clipped n-gram matches of orders 1..``top``: pairs x orders. ``ids`` (from
    0, below ``symbols``) holds all sequences one after another, first the
    hypotheses, then the references; hypothesis i meets sequence ``ref_of[i]``.
    Runs of hypotheses of at most ``COUNT_SYMBOLS`` symbols (or one longer) are
    counted together, with the symbols that occur in them numbered anew."""
    pairs, stops = len(ref_of), np.cumsum(lens)
    starts, out, a = stops - lens, [], 0
    while a < pairs:
        z = max(a + 1, int(np.searchsorted(stops[:pairs], starts[a] + COUNT_SYMBOLS, "right")))
        refs, meets = np.unique(ref_of[a:z], return_inverse=True)
        held = np.concatenate([ids[starts[a]:stops[z - 1]], *[ids[starts[r]:stops[r]] for r in refs.tolist()]])
        there = np.zeros(symbols, dtype=bool)
        there[held] = True
        number = np.cumsum(there) - 1
        out.append(_matches(number[held], np.concatenate([lens[a:z], lens[refs]]), meets + (z - a), top, int(there.sum())))
        a = z
    return np.concatenate(out) if out else np.zeros((0, top), dtype=np.int64)


def _matches(ids: np.ndarray, lens: np.ndarray, ref_of: np.ndarray, top: int, symbols: int) -> np.ndarray:
    """``pair_matches`` of one run.

    Every position has the key of its window of ``top`` symbols, filled up past
    the end with a symbol that only its side has. A pair's windows are sorted
    together, so equal n-grams are neighbours for every n; where one ends follows
    from the highest bit in which two neighbours differ. Only the sorting goes
    pair by pair. Of the windows of both sides, those of an n-gram that one side
    has more often are left over; the others are matches, two to each."""
    pairs, stops = len(ref_of), np.cumsum(lens)
    starts = stops - lens
    bits = (symbols + 2).bit_length()
    if bits * top > 60:  # too many distinct symbols for one key
        return _pair_by_pair(ids, starts, stops, ref_of, top)
    gap = lens + top - 1
    first = np.cumsum(gap) - gap
    theirs = int(gap[:pairs].sum())
    filled = np.zeros(int(gap.sum()), dtype=np.int64)
    filled[:theirs] = 1
    for f, a, z in zip(first.tolist(), starts.tolist(), stops.tolist()):
        np.add(ids[a:z], 2, out=filled[f:f + z - a])
    key = _windows(filled, top, bits)
    key <<= 1
    key[:theirs] |= 1
    both_len = lens[:pairs] + lens[ref_of]
    ends_of = np.cumsum(both_len)
    both = np.empty(int(both_len.sum()), dtype=np.int64)
    a = 0
    for f, n, g, m in zip(first.tolist(), lens.tolist(), first[ref_of].tolist(), lens[ref_of].tolist()):
        part = both[a:a + n + m]
        part[:n] = key[f:f + n]
        part[n:] = key[g:g + m]
        part.sort()
        a += n + m
    some = both_len > 0
    differ = np.empty_like(both)
    np.bitwise_xor(both[1:], both[:-1], out=differ[:-1])
    differ[ends_of[some] - 1] = LAST  # a pair's last one ends every gram
    both &= 1
    before = np.cumsum(both, out=both)
    ends = np.flatnonzero(differ > 1)
    last, lead = differ[ends], (2 * before[ends] - ends - 1).astype(np.int32)
    out = np.zeros((pairs, top), dtype=np.int64)
    if not some.any():
        return out
    done = np.flatnonzero(last == LAST)
    for o in range(top, 0, -1):  # grams of a shorter order end at some of the ends
        if o < top:
            stay = np.flatnonzero(last >= np.int64(1) << (bits * (top - o) + 1))  # taking by position is faster than by mask
            last, lead, done = last[stay], lead[stay], np.searchsorted(stay, done)
        over = lead.copy()
        over[1:] -= lead[:-1]
        np.abs(over, out=over)
        begin = np.concatenate([[0], done[:-1] + 1])
        out[some, o - 1] = (both_len[some] - np.add.reduceat(over, begin, dtype=np.int64)) // 2
    return out


LAST = np.int64((1 << 63) - 1)


def _windows(ids: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The key of the ``width`` symbols from every position on (fewer at the end)."""
    if width == 1:
        return ids.copy()
    half = width // 2
    own = _windows(ids, half, bits)
    key = own << (bits * half)
    key[:len(key) - half] |= own[half:]
    if width % 2:
        key <<= bits
        key[:len(key) - width + 1] |= ids[width - 1:]
    return key


def _pair_by_pair(ids, starts, stops, ref_of, top: int) -> np.ndarray:
    """``_matches`` with the symbols of each pair numbered by themselves."""
    out = np.zeros((len(ref_of), top), dtype=np.int64)
    for i, r in enumerate(ref_of.tolist()):
        a, b = ids[starts[i]:stops[i]], ids[starts[r]:stops[r]]
        known, own = np.unique(np.concatenate([a, b]), return_inverse=True)
        if (len(known) + 2).bit_length() * top <= 60:
            out[i] = _matches(own.astype(np.int64), np.array([len(a), len(b)]), np.array([1]), top, len(known))[0]
        else:
            own = own.astype(np.int64)
            out[i] = _orders(own[:len(a)], own[len(a):], len(known), range(1, top + 1))[2::3]
    return out


def _chrf_rows(words: Words, of: ByWord, ref_of: np.ndarray) -> list[list[int]]:
    cols = []
    for (ids, lens, k), top in ((words.chars(), CHAR_ORDER), (words.tokens(of), WORD_ORDER)):
        matched, there, here = pair_matches(ids, lens, ref_of, top, k), lens[:len(ref_of)], lens[ref_of]
        for o in range(top):
            cols += [np.maximum(there - o, 0), np.maximum(here - o, 0), matched[:, o]]
    return np.stack(cols, axis=1).tolist()


def bleu_rows(ids: np.ndarray, lens: np.ndarray, symbols: int, ref_of: np.ndarray) -> list[list[int]]:
    """The ten BLEU counts of every pair (see ``pair_matches``)."""
    matched, there = pair_matches(ids, lens, ref_of, BLEU_ORDER, symbols), lens[:len(ref_of)]
    return np.column_stack([there, lens[ref_of], matched, *[np.maximum(there - o, 0) for o in range(BLEU_ORDER)]]).tolist()


def lcs_of_many(ref: np.ndarray, hyps: list[np.ndarray]) -> list[int]:
    """LCS length of a reference and each hypothesis. The hypotheses lie side by
    side as the bits of one integer, with free bits between them for the carries,
    so that a step over a token of the reference serves all of them; as many at
    a time as have masks of ``MASK_BYTES``."""
    distinct, out, a = max(1, len(np.unique(ref))), [], 0
    sizes = [len(h) + GUARD_BITS for h in hyps]
    while a < len(hyps):
        z, bits = a + 1, sizes[a]
        while z < len(hyps) and (bits + sizes[z]) * distinct <= 8 * MASK_BYTES:
            bits, z = bits + sizes[z], z + 1
        if bits * distinct > 8 * MASK_BYTES:  # one long pair
            out.append(lcs(ref.tolist(), hyps[a].tolist()))
        else:
            out += _side_by_side(ref, hyps[a:z])
        a = z
    return out


def _side_by_side(ref: np.ndarray, hyps: list[np.ndarray]) -> list[int]:
    lens = np.array([len(h) for h in hyps], dtype=np.int64)
    first = np.cumsum(lens + GUARD_BITS) - lens - GUARD_BITS
    width = (int((lens + GUARD_BITS).sum()) + 7) // 8
    symbols = np.concatenate(hyps)
    at = np.repeat(first - (np.cumsum(lens) - lens), lens) + np.arange(len(symbols))
    known = np.unique(ref)
    row = np.searchsorted(known, symbols)
    row[row == len(known)] = 0
    common = known[row] == symbols if len(known) else np.zeros(len(symbols), dtype=bool)
    bits = np.zeros(len(known) * width, dtype=np.uint8)
    place = at[common]
    np.bitwise_or.at(bits, row[common] * width + (place >> 3), (1 << (place & 7)).astype(np.uint8))
    held = bits.tobytes()
    masks = [int.from_bytes(held[i:i + width], "little") for i in range(0, len(held), width)]
    steps = [m for m in map(masks.__getitem__, np.searchsorted(known, ref).tolist()) if m]
    full = sum(((1 << n) - 1) << f for f, n in zip(first.tolist(), lens.tolist()))
    v = full
    for i in range(0, len(steps), GUARD_BITS):
        for m in steps[i:i + GUARD_BITS]:
            u = v & m
            v = (v + u) | (v ^ u)
        v &= full
    return [n - ((v >> f) & ((1 << n) - 1)).bit_count() for f, n in zip(first.tolist(), lens.tolist())]


def _rouge_rows(words: Words, of: ByWord, ref_of: np.ndarray) -> list[list[int]]:
    ids, lens, _ = words.tokens(of)
    stops = np.cumsum(lens)
    one = lambda i: ids[stops[i] - lens[i]:stops[i]]
    matched, order = np.zeros(len(ref_of), dtype=np.int64), np.argsort(ref_of, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(ref_of[order])) + 1):
        matched[own] = lcs_of_many(one(ref_of[own[0]]), [one(i) for i in own.tolist()])
    return np.stack([matched, lens[:len(ref_of)], lens[ref_of]], axis=1).tolist()


def chunks(hyps: list, refs: list, size=len):
    """Runs of pairs as (texts, ref_of): the hypotheses, then the distinct
    references; at most ``CHUNK_CHARS`` of each by ``size``, or one longer pair.
    Systems scored on one test set share references: rows are spread by the
    reference key, so repeats meet and are cut and counted once."""
    own, seen, at, held, kept = [], {}, [], 0, 0
    for h, r in zip(hyps, refs):
        more = 0 if r in seen else size(r)
        if own and (held + size(h) > CHUNK_CHARS or kept + more > CHUNK_CHARS):
            yield own + list(seen), np.array(at) + len(own)
            own, seen, at, held, kept, more = [], {}, [], 0, 0, size(r)
        own.append(h)
        at.append(seen.setdefault(r, len(seen)))
        held, kept = held + size(h), kept + more
    if own:
        yield own + list(seen), np.array(at) + len(own)


class SegmentStats:
    """chrF++ (24), BLEU-13a (10) and ROUGE-L ([lcs, |h|, |r|]) rows of pairs, those asked for."""

    def __init__(self, rouge: bool, stem: bool, chrf: bool, bleu: bool):
        from corpuslab.functions.porter import stem_cached

        keep_freed_memory()
        cw, t13, rw = _py_tokenisers()
        def stemmed(words):
            return [[stem_cached(t) if len(t) > 3 else t for t in found] for found in rw.of_words(words)]

        self.chrf_of, self.bleu_of = ByWord(cw.of_words, letters_only), ByWord(t13.of_words, letters_only)
        self.rouge_of = ByWord(stemmed, own_stems) if stem else ByWord(rw.of_words)
        self.rouge, self.chrf, self.bleu = rouge, chrf, bleu

    def rows(self, hyps: list[str], refs: list[str]) -> dict[str, list]:
        out = {"chrf": [], "bleu": [], "rouge": []}
        for texts, ref_of in chunks(hyps, refs):
            none = [None] * len(ref_of)
            words = Words(texts) if self.chrf or self.rouge else None
            out["chrf"] += _chrf_rows(words, self.chrf_of, ref_of) if self.chrf else none
            out["rouge"] += _rouge_rows(words, self.rouge_of, ref_of) if self.rouge else none
            if self.bleu:
                ready = [pre_13a(t) for t in texts]
                words = words if words and ready == texts else Words(ready)
                ids, lens, k = words.tokens(self.bleu_of)
            out["bleu"] += bleu_rows(ids, lens, k, ref_of) if self.bleu else none
        return out


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, '' for null."""
    return [x or "" for x in column.to_numpy(zero_copy_only=False)]


def arrow_stats(made: SegmentStats, parts) -> Iterator[pa.StructArray]:
    """The statistics of batches (hypotheses, references) that stay in Arrow:
    ``SLICE_ROWS`` of their rows are Python objects at a time."""
    counts = pa.list_(pa.int64())
    for h, r in parts:
        cols = {"chrf": [], "bleu": [], "rouge": []}
        for at in range(0, len(h), SLICE_ROWS):
            hyps, refs = (texts_of(x.slice(at, SLICE_ROWS)) for x in (h, r))
            for name, rows in made.rows(hyps, refs).items():
                cols[name].append(pa.array(rows, counts))
        yield pa.StructArray.from_arrays([pa.chunked_array(c, counts).combine_chunks() for c in cols.values()], list(cols))


def segment_stats(hyp: Column, ref: Column, rouge: bool, stem: bool, chrf: bool, bleu: bool) -> Column:
    """The statistics of ``SegmentStats`` as a struct; texts are already folded / stripped."""
    @F.arrow_udf(STATS_TYPE)
    def stats(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from arrow_stats(SegmentStats(rouge, stem, chrf, bleu), parts)

    return stats(hyp, ref)


@F.arrow_udf(T.ArrayType(T.LongType()))
def spaced_bleu_stats(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """The ten BLEU counts of texts whose tokens white space parts; a reference
    that several systems share is cut once."""
    keep_freed_memory()
    counts, parts = pa.list_(pa.int64()), []
    for at in range(0, len(hyp), SLICE_ROWS):
        hyps, refs = (texts_of(x.slice(at, SLICE_ROWS)) for x in (hyp, ref))
        for texts, ref_of in chunks(hyps, refs):
            parts.append(pa.array(bleu_rows(*Words(texts).tokens(SPACED), ref_of), counts))
    return pa.chunked_array(parts, counts).combine_chunks()


def token_bleu_rows(hyps: list, refs: list) -> list[list[int]]:
    """The ten BLEU counts of pairs of token lists."""
    keep_freed_memory()
    out: list[list[int]] = []
    for texts, ref_of in chunks([tuple(x) for x in hyps], [tuple(x) for x in refs]):
        ids, vocabulary = _numbered(chain.from_iterable(texts))
        out += bleu_rows(ids, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), len(vocabulary), ref_of)
    return out


def token_runs(hyp_sizes: np.ndarray, ref_sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) with at most ``CHUNK_CHARS`` tokens a side, or one longer row."""
    hyps, refs, at = np.cumsum(hyp_sizes), np.cumsum(ref_sizes), 0
    while at < len(hyps):
        to = min(int(np.searchsorted(c, (c[at - 1] if at else 0) + CHUNK_CHARS, "right")) for c in (hyps, refs))
        yield at, max(to, at + 1)
        at = max(to, at + 1)


def arrow_bleu_rows(hyps: pa.Array, refs: pa.Array) -> Iterator[list[list[int]]]:
    """``token_bleu_rows`` of two Arrow arrays of token lists, a run of rows at a
    time; Arrow numbers the tokens, which never are Python objects."""
    keep_freed_memory()
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (hyps, refs)]
    for a, z in token_runs(*sizes):
        tokens = pa.concat_arrays([x.slice(a, z - a).flatten() for x in (hyps, refs)]).dictionary_encode("encode")
        lens = np.concatenate([n[a:z] for n in sizes])
        yield bleu_rows(tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64), lens, len(tokens.dictionary),
                        np.arange(z - a, 2 * (z - a)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def bleu_stats(h_tokens: pa.Array, r_tokens: pa.Array) -> pa.Array:
    counts = pa.list_(pa.int64())
    return pa.chunked_array([pa.array(rows, counts) for rows in arrow_bleu_rows(h_tokens, r_tokens)], counts).combine_chunks()
