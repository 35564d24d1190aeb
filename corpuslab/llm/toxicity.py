"""Toxic passages by maximum-scoring segment search.

Fitting (on a bounded labelled sample): tokens are lower-cased runs of letters,
and the first 4 to 7 letters of a word marked as stems; the longest known stem
stands in for a word that was not seen often enough. A token's score is its log-odds between
toxic and clean documents under an informative Dirichlet prior (prior counts in
proportion to the token's frequency in both), counted once a document, and only
kept when it exceeds a least gain and the classes' rates are some standard errors
apart; every other token costs ``drift``. Which of the ``choices`` of these two
limits holds is decided on the part of the sample that is kept for calibration.
So long stretches score below zero and the segments that score above it are
the toxic passages.

Scoring (a map over documents): one linear scan finds all maximal scoring
segments of the whole text. Their sums follow an extreme-value law in clean
text: with lambda the root of sum p(s) exp(lambda s) = 1 over clean tokens, a
segment of sum S in n tokens has a P-value of 1 - exp(-K n exp(-lambda S)). A
document's evidence is the sum of lambda S over the segments expected at most
once by chance (at least the best one) less ln n, and a Gumbel link, whose place and width are
fitted on the sample's labels, turns it into a probability.

Defined cases: null, empty or letterless text has the score of a document
without evidence (below 0.5 unless nearly all of the sample is toxic); null
labels are not learned from; no labelled rows, or one class only -> the share of
toxic rows for every document; one output row per input row; an empty table ->
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import append_columns, labelled_sample, materialize

_WORD = re.compile(r"[^\W\d_]+")
STEMS = (7, 6, 5, 4)
_MEMO_WORDS = 500_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _tokens(word: str) -> tuple[str, ...]:
    return (word, *[word[:k] + "*" for k in STEMS if len(word) > k])


def maximal_segments(places: np.ndarray, gains: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of a text as (sum, first, last + 1) of the
    word positions. ``places`` are the words with a positive score ``gains``;
    every word between them costs ``drift``. Ruzzo and Tompa's scan, with the
    runs between positive words taken in one step. A segment remembers the last
    one before it with a smaller left sum; looking for one jumps along these and
    never meets a segment twice, so the time is linear in the positive words."""
    found: list[list[float]] = []  # left, right (running sums), first, last + 1, last with a smaller left
    total, at = 0.0, 0
    for i, g in zip(places.tolist(), gains.tolist()):
        total -= drift * (i - at)
        left, right, first = total, total + g, i
        total, at = right, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = found[j][4]
            if j < 0 or found[j][1] >= right:
                break
            left, first = found[j][0], int(found[j][2])
            del found[j:]
        found.append([left, right, first, at, j])
    return [(r - l, int(a), int(b)) for l, r, a, b, _ in found]


@dataclass
class ToxicityModel:
    base_rate: float
    drift: float = 1.0
    lam: float = 1.0
    k: float = 1.0
    alpha: float = 0.01
    place: float = 0.0
    width: float = 0.0  # 0: no evidence is used
    gains: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict)

    def segments(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of words and all maximal segments of a text."""
        own = words(text)
        memo = self.memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        for w in own:
            if w not in memo:
                memo[w] = next((self.gains[t] for t in _tokens(w) if t in self.gains), 0.0)
        hit = [(i, g) for i, w in enumerate(own) if (g := memo[w])]
        if not hit:
            return len(own), []
        at, g = zip(*hit)
        return len(own), maximal_segments(np.array(at), np.array(g), self.drift)

    def significant(self, n: int, found: list) -> list[tuple[float, int, int, float]]:
        """(sum, first, last + 1, P-value) of every significant passage."""
        ps = [-math.expm1(-self.k * n * math.exp(-min(700.0, self.lam * s))) for s, _, _ in found]
        return [(*x, p) for x, p in zip(found, ps) if p <= self.alpha]

    def evidence(self, n: int, found: list) -> float:
        """Sum of the passages expected at most once by chance, on the scale
        of the extreme-value law; the best segment if there is none."""
        chance = math.log(max(1.0, self.k * n))
        scaled = [self.lam * s for s, _, _ in found]
        strong = [x for x in scaled if x >= chance]
        return (sum(strong) if strong else max(scaled, default=-1.0)) - math.log(max(1, n))

    def probability(self, evidence: float) -> float:
        if not self.width:
            return self.base_rate
        z = (evidence - self.place) / self.width
        return math.exp(-math.exp(-max(-30.0, min(30.0, z))))  # Gumbel distribution function


def _lambda(gains: np.ndarray, weight: np.ndarray, drift: float, rest: float) -> float:
    """Positive root of sum p exp(lambda s) = 1 (bisection)."""
    total = weight.sum() + rest

    def over(x: float) -> float:
        return float((weight * np.exp(np.minimum(700, x * gains))).sum() + rest * math.exp(-x * drift)) / total - 1

    low, high = 1e-6, 1.0
    if over(low) >= 0:
        return low  # the mean score is not negative
    while over(high) < 0 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return low


#: (standard errors apart, least gain in log-odds) that ``fit`` chooses from: from lenient to strict.
CHOICES = tuple((z, g) for z in (2.5, 3.5, 5.0, 7.0) for g in (0.7, 1.6, 2.5, 3.5))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8000, choices=CHOICES, prior: float = 5.0,
        drift: float = 0.05, alpha: float = 0.01, seed: int = 6) -> ToxicityModel:
    """Learn from ``docs`` (doc_id, text) joined with ``labels`` (doc_id,
    toxic). ``per_class`` bounds the sample of each class, from which both the
    token scores (three quarters) and the calibration (the rest) are learned.
    Of ``choices`` the one with the least calibration loss is taken."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known.join(docs.select("doc_id").distinct(), "doc_id"), "labelled")  # ids only
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    model = ToxicityModel(base_rate=rate, drift=drift, alpha=alpha)
    if not sizes.get(0) or not sizes.get(1):
        return model
    # the ids are sampled before any text moves; about 2 * per_class of them
    chosen = labelled_sample(known, "toxic", per_class, seed, "doc_id")
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(4)).alias("part"))
                         .dropDuplicates(["text", "toxic"]), "labelled-texts")  # copies are one witness

    def count(batches):
        once, every, docs_seen = [Counter(), Counter()], Counter(), [0, 0]
        for b in batches:
            for text, y, part in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("part").to_pylist()):
                if part == 3:
                    continue  # kept for the calibration
                own = words(text)
                docs_seen[y] += 1
                once[y].update({t for w in set(own) for t in _tokens(w)})
                if not y:
                    every.update(t for w in own for t in _tokens(w))
        names = list(once[0].keys() | once[1].keys()) + [""]
        once[0][""], once[1][""] = docs_seen
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *[pa.array([c[t] for t in names], pa.int64()) for c in (once[0], once[1], every)]],
            ["token", "clean", "toxic", "uses"])

    counts = (sample.mapInArrow(count, "token string, clean long, toxic long, uses long")
              .groupBy("token").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "uses")]).persist())
    n = counts.filter("token = ''").first()
    total = counts.filter("token <> ''").agg(*[F.sum(c).cast("double").alias(c) for c in ("clean", "toxic")]).first()
    uses = counts.filter("token not like '%*'").agg(F.sum("uses")).first()[0] or 1
    scale = prior / (n["clean"] + n["toxic"])  # prior counts: ``prior`` documents with every token at its usual rate
    own = (F.col("clean") + F.col("toxic")) * scale
    every = (total["clean"] + total["toxic"]) * scale
    y1, y0 = F.col("toxic") + own, F.col("clean") + own
    odds = F.log(y1 / (total["toxic"] + every - y1)) - F.log(y0 / (total["clean"] + every - y0))
    # how many standard errors the two rates are apart if both classes used the token alike
    pooled = (F.col("toxic") + F.col("clean")) / (total["toxic"] + total["clean"])
    apart = ((F.col("toxic") / total["toxic"] - F.col("clean") / total["clean"])
             / F.sqrt(pooled * (1 / total["toxic"] + 1 / total["clean"])))
    able = (counts.filter("token <> ''").withColumn("gain", odds).withColumn("apart", apart)
            .filter(F.col("apart") > min(z for z, _ in choices)).filter(F.col("gain") > min(g for _, g in choices))
            .select("token", "gain", "apart", "uses").toPandas())  # tokens of a bounded sample
    counts.unpersist()

    def chosen_by(z: float, least_gain: float) -> ToxicityModel:
        kept = able[(able["apart"] > z) & (able["gain"] > least_gain)]
        plain = kept[~kept["token"].str.endswith("*")]
        lam = _lambda(plain["gain"].to_numpy(float), plain["uses"].to_numpy(float) + 0.5, drift,
                      max(1.0, uses - plain["uses"].sum()))
        return replace(model, lam=lam, gains=dict(zip(kept["token"], kept["gain"])), memo={})

    models = [chosen_by(*c) for c in choices]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, m in enumerate(shared.value):
                seen = [m.segments(t) for t in texts]
                best = [max((s for s, _, _ in found), default=0.0) for _, found in seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), i, dtype=np.int32)), b.column("toxic"),
                     pa.array([m.evidence(*x) for x in seen], pa.float64()),
                     pa.array(best, pa.float64()), pa.array([n for n, _ in seen], pa.int64())],
                    ["choice", "toxic", "evidence", "best", "n"])

    apart = {r["toxic"]: r["count"] for r in sample.filter("part = 3").groupBy("toxic").count().collect()}
    enough = min(apart.get(0, 0), apart.get(1, 0)) >= 5  # else the whole small sample calibrates too
    every = (sample.filter("part = 3") if enough else sample).mapInArrow(
        measure, "choice int, toxic int, evidence double, best double, n long").toPandas()  # of a bounded sample
    loss = math.inf
    for i, own in enumerate(models):
        _calibrate(own, every[every["choice"] == i], rate)
        seen = every[every["choice"] == i]
        if (now := _loss(own, seen, rate)) < loss:
            loss, model = now, own
    model.memo = {}
    return model


def _calibrate(model: ToxicityModel, seen, rate: float) -> None:
    # K: the mean of exp(lambda S) / n over clean documents' best segments
    clean = seen[(seen["toxic"] == 0) & (seen["n"] > 0)]
    if len(clean):
        model.k = float(np.clip(np.median(np.exp(np.minimum(50, model.lam * clean["best"])) / clean["n"]), 1e-3, 1.0))
    if seen["toxic"].nunique() == 2:
        model.place, model.width = _gumbel(seen["evidence"].to_numpy(float), seen["toxic"].to_numpy(float),
                                           rate)


def _weights(y: np.ndarray, rate: float) -> np.ndarray:
    """Weights of calibration rows that restore the share of toxic rows."""
    return np.where(y == 1, rate / max(1e-9, y.mean()), (1 - rate) / max(1e-9, 1 - y.mean()))


def _loss(model: ToxicityModel, seen, rate: float) -> float:
    """Weighted log loss of the calibrated model on the calibration rows."""
    y = seen["toxic"].to_numpy(float)
    p = np.clip([model.probability(x) for x in seen["evidence"]], 1e-6, 1 - 1e-6)
    return -float((_weights(y, rate) * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()) if len(y) else math.inf


def _gumbel(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Place and width of the Gumbel link with the best likelihood; rows are
    weighted back to the share of toxic rows before the sample was drawn."""
    w = _weights(y, rate)
    best = (math.inf, 0.0, 1.0)
    steps = np.unique(np.quantile(x, np.linspace(0, 1, 161)))
    for place in np.concatenate([steps, (steps[1:] + steps[:-1]) / 2]):
        for width in (0.1, 0.2, 0.5, 1, 2, 3, 5, 8, 12, 20, 40):
            z = np.clip((x - place) / width, -30, 30)
            p = np.clip(np.exp(-np.exp(-z)), 1e-6, 1 - 1e-6)
            loss = -float((w * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum())
            if loss < best[0]:
                best = (loss, float(place), float(width))
    return best[1], best[2]


def score(df: DataFrame, model: ToxicityModel) -> DataFrame:
    """``df`` with toxic_score (0 to 1) and passages: significant segments as
    (first word, last word + 1, sum, P-value). One map pass."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # tokens: bounded by the sample
    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                        T.StructField("sum", T.DoubleType()), T.StructField("p", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("sum", pa.float64()), ("p", pa.float64())]))

    def run(texts):
        m, scores, found = shared.value, [], []
        for t in texts.to_pylist():
            seen = m.segments(t)
            scores.append(m.probability(m.evidence(*seen)))
            found.append([{"first": a, "end": b, "sum": s, "p": p} for s, a, b, p in m.significant(*seen)])
        return [pa.array(scores, pa.float64()), pa.array(found, arrow)]

    return append_columns(df, ["text"], {"toxic_score": T.DoubleType(), "passages": passage}, run)
