"""Language identification with language-bitmask n-gram filters.

Fitting: character n-grams (n = 3 and 4, inside words, with a word boundary
mark) of a bounded labelled sample are counted per language. A gram enters the
filter of a language when it makes up at least ``floor`` of that language's
grams and at least ``ratio`` of its share in the language where it is most
frequent. All filters are one bit-sliced Bloom filter: each slot holds a mask
with one bit per language, so ANDing the slots of a gram's hashes returns the
set of languages whose filter contains it. At most 1/floor grams per language
and length can pass, so the filter's size depends on the number of languages
only, not on the corpus.

Prediction (a map over documents, no shuffle): per language, the number of the
document's grams whose mask has the language's bit, corrected for the false
positives that the filter's filling predicts and divided by the share of the
language's own grams that its filter covers. The largest decides.

Defined cases: null text or text without a letter -> ``und``, score 0; no gram
known to any filter -> the language most frequent in training, score 0; ties ->
the smaller language name; nothing to learn from -> ``und`` everywhere; one
output row per input row, repeated rows included; an empty table -> no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import append_columns, labelled_sample, plain_names, text_slices

SIZES = (3, 4)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]):
    """For each n of SIZES: (n, 64-bit gram hashes, index of the text of each)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    doc = np.repeat(np.arange(len(low) + 1), [*(len(t) + 1 for t in low), 1])
    x = np.where(_letters()[codes], codes, 0)
    keep = x != 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    x, doc = x[keep].astype(np.uint64), doc[keep]
    inner, h = x != 0, x.copy()
    ok = np.ones(len(x), dtype=bool)
    for n in range(2, max(SIZES) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        h = h[:m] * _MULT + x[n - 1:]
        ok = ok[:m] & inner[n - 2:n - 2 + m] if n > 2 else ok[:m]
        if n in SIZES:
            g = h[ok] + np.uint64(n)
            g = (g ^ (g >> np.uint64(31))) * _MIX
            g ^= g >> np.uint64(29)
            first = np.flatnonzero(ok)
            yield n, g, doc[first + 1]  # the second character of a gram is a letter of its text


def _slots(g: np.ndarray, bits: int, hashes: int):
    step = (g >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((g + step * np.uint64(i)) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    langs: list[str]  # bit order
    prior: list[int]  # training documents of each
    masks: np.ndarray  # slots x words of 64 languages
    bits: int
    hashes: int
    cover: np.ndarray  # per length and language: share of its own grams in its filter

    def false_positives(self) -> np.ndarray:
        fill = [((self.masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(self.langs))]
        return np.array(fill) ** self.hashes

    def hits(self, g: np.ndarray) -> np.ndarray:
        out = None
        for s in _slots(g, self.bits, self.hashes):
            out = self.masks[s] if out is None else out & self.masks[s]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """texts x languages: covered share of the text's grams, in 0..1 or so."""
        fp = self.false_positives() if not hasattr(self, "_fp") else self._fp
        self._fp = fp
        out = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        expect = np.zeros_like(out)
        for k, (_, g, doc) in enumerate(grams(texts)):
            n = np.bincount(doc, minlength=len(texts))[:len(texts)]
            hit = self.hits(g)
            for j in range(len(self.langs)):
                on = (hit[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
                c = np.bincount(doc, weights=on, minlength=len(texts))[:len(texts)]
                out[:, j] += np.maximum(0, (c - n * fp[j]) / (1 - min(fp[j], 0.99)))
            expect += n[:, None] * self.cover[k][None, :]
            total += n
        return np.divide(out, expect, out=np.zeros_like(out), where=expect > 0)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        s = self.scores(texts) if self.langs else None
        fallback = max(range(len(self.langs)), key=lambda j: self.prior[j], default=None)
        names, scores = [], []
        for i, t in enumerate(texts):
            if s is None or not any(c.isalpha() for c in t):
                names.append("und")
                scores.append(0.0)
            elif s[i].max() <= 0:
                names.append(self.langs[fallback])
                scores.append(0.0)
            else:
                j = int(s[i].argmax())
                names.append(self.langs[j])
                scores.append(float(s[i, j] / s[i].sum()))
        return names, scores


def fit(train: DataFrame, per_language: int = 1500, floor: float = 2e-5, ratio: float = 0.3,
        bits_per_gram: int = 12, hashes: int = 3, seed: int = 1) -> LanguageFilter:
    """Learn from columns (doc_id, text, lang), null lang or text excluded; doc_id only decides who is in the sample. ``per_language``
    bounds the labelled rows used of each language (all rows of a rarer one)."""
    rows = plain_names(train, "doc_id", "text", "lang").filter("lang is not null and text is not null")
    sample = labelled_sample(rows, "lang", per_language, seed, "doc_id", "text")

    def count(batches):
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                for _, part in text_slices(own):
                    for n, g, _ in grams(part):
                        u, c = np.unique(g, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(u)), pa.array(np.full(len(u), n, dtype=np.int32)),
                             pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "gram", "c"])

    counts = (sample.mapInArrow(count, "lang string, n int, gram long, c long")
              .groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    docs = {r["lang"]: r["d"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("d")).collect()}
    counts = counts.persist()  # of a bounded sample
    totals = counts.groupBy("lang", "n").agg(F.sum("c").alias("total"))
    kept = (counts.join(F.broadcast(totals), ["lang", "n"])  # one row per language and length
            .withColumn("p", F.col("c") / F.col("total")).filter(F.col("p") >= floor)
            .select("lang", "n", "gram", "p").toPandas())
    counts.unpersist()
    langs = sorted(set(kept["lang"]))
    kept = kept.sort_values(["n", "gram", "lang"])
    top = kept.groupby(["n", "gram"])["p"].transform("max")
    kept = kept[kept["p"] >= ratio * top]
    distinct = len(kept[["n", "gram"]].drop_duplicates())
    bits = max(10, int(np.ceil(np.log2(max(1, distinct * bits_per_gram)))))
    masks = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    cover = np.zeros((len(SIZES), len(langs)))
    for j, lang in enumerate(langs):
        own = kept[kept["lang"] == lang]
        for s in _slots(own["gram"].to_numpy().view(np.uint64), bits, hashes):
            masks[s, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        for k, n in enumerate(SIZES):
            cover[k, j] = own.loc[own["n"] == n, "p"].sum()
    return LanguageFilter(langs, [docs[x] for x in langs], masks, bits, hashes, cover)


def identify(df: DataFrame, model: LanguageFilter) -> DataFrame:
    """``df`` (any columns, among them ``text``) with ``lang_pred`` and
    ``lang_score`` appended; one map pass, nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # size: see the module text

    def run(texts):
        pred, score = [], []
        for _, part in text_slices(texts.to_pylist()):
            p, s = shared.value.predict(part)
            pred += p
            score += s
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return append_columns(df, ["text"], {"lang_pred": T.StringType(), "lang_score": T.DoubleType()}, run)
