import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import pii

from .conftest import prose

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                  "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def card(r):
    while True:
        d = "4" + "".join(r.choice("0123456789") for _ in range(15))
        if luhn(d):
            return d


@pytest.fixture(scope="module")
def docs(make_docs, odd_docs):
    r = random.Random(1)
    alphabet = "ab@.c%1234567890--+ () é."
    rows = [(1000 + i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 120))), "en", "s") for i in range(300)]
    fixed = ["a@b.c%x@d.e f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "+1 (555) 555-1234 +12", "4" * 20000, "a" * 20000 + "@",
             "x@y.z" * 50, "\U0001f600 a@b.co 10.0.0.1", "4111 1111 1111 1111, 4111-1111-1111-1112", "..@a.b-.c"]
    rows += [(2000 + i, t, "en", "s") for i, t in enumerate(fixed)]
    makes = [lambda: f"{r.choice('abc')}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: card(r),
             lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}",
             lambda: str(r.randint(10 ** 9, 10 ** 17))]
    for i in range(600):
        words = prose("en", 20, i).split()
        words[10:10] = [r.choice(makes)()]
        rows.append((3000 + i, " ".join(words), "en", "s"))
    return make_docs(rows).unionByName(odd_docs)


def test_base_spans_match_brute_force(docs):
    out = {}
    for x in pii.with_spans(docs).collect():
        out.setdefault(x["doc_id"], []).append(x)
    n = 0
    for d in docs.collect():
        if d["doc_id"] is None:
            continue
        want, x = base(d["text"]), out[d["doc_id"]][0]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), d["text"][:200]
        for kind, _ in KINDS:
            assert x[f"n_{kind}"] == sum(s.startswith(kind) for s in want)
        got = x["spans"].split(",") if x["spans"] else []
        assert set(want) <= set(got)
        n += len(want)
    assert sum(map(len, out.values())) == docs.count() and n > 500
    assert len(out[7]) == 3


def test_redaction(docs):
    rows = pii.redact(docs)
    assert rows.columns == docs.columns
    rows = rows.collect()
    assert len(rows) == docs.count()
    text = {d["doc_id"]: d["text"] for d in docs.collect()}
    for x in rows:
        if x["doc_id"] is not None and not base(text[x["doc_id"]]) and "[" not in (x["text"] or ""):
            assert x["text"] == text[x["doc_id"]]
        if x["doc_id"] and 3000 <= x["doc_id"] < 3600:
            for s in base(text[x["doc_id"]]):
                _, a, b = s.split(":")
                assert text[x["doc_id"]][int(a):int(b)] not in x["text"]


def test_empty_and_untrainable(docs, make_docs):
    assert pii.with_spans(docs.limit(0)).count() == 0
    (x,) = pii.with_spans(make_docs([(1, "mail a@b.co or +1 (555) 555-1234", "en", "s")])).collect()
    assert (x["n_email"], x["n_phone"], x["spans"]) == (1, 1, "email:5:11,phone:15:32")


def test_disguised_spans_are_added(make_docs):
    r = random.Random(3)
    octets = lambda: [str(r.randint(11, 255)) for _ in range(4)]
    group = lambda sep, d: sep.join(d[i:i + 4] for i in range(0, 16, 4))
    phone = lambda: (r.randint(200, 999), r.randint(1000, 9999))
    plain = [lambda: f"{prose('en', 1, r.randint(0, 99))}{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: card(r),
             lambda: ".".join(octets()), lambda: "+1 ({}) 555-{}".format(*phone())]
    hidden = {"email": ["jane [at] host [dot] org", "j.doe(at)mail(dot)example(dot)com", "kim [at] host.net"],
              "ip": [" . ".join(octets()), ". ".join(octets())],
              "card": [group(".", card(r)), group(" - ", card(r))],
              "phone": ["({}) 555-{}".format(*phone()), "1 ({}) 555-{}".format(*phone()), "{}.555.{}".format(*phone())]}
    decoys = ["this @ house. under", "the @ 5.30", "300 . 1 . 2 . 3", "1. 2. 3. 4", "2024-05-17", "1234567890", "12 345 678",
              group(".", "4111111111111112"), "4111111111111112"]
    texts = {}
    for i in range(800):
        texts[i] = (None, None, plain[i % 4]())
    for kind, forms in hidden.items():
        for x in forms:
            texts[len(texts)] = (kind, x, x)
    for x in decoys:
        texts[len(texts)] = ("none", x, x)
    full = {i: f"{prose('en', 10, i)} {t[2]} {prose('en', 10, i + 5000)}" for i, t in texts.items()}
    table = make_docs([(i, t, "en", "s") for i, t in full.items()])
    spans = {x["doc_id"]: x["spans"] for x in pii.with_spans(table).collect()}
    clean = {x["doc_id"]: x["text"] for x in pii.redact(table).collect()}
    for i, (kind, x, _) in texts.items():
        if kind == "none":
            assert spans[i] == "" and clean[i] == full[i], x
        elif kind:
            at = full[i].index(x)
            assert spans[i] == f"{kind}:{at}:{at + len(x)}", x
            assert f"[{kind.upper()}]" in clean[i] and x not in clean[i]


def test_trees_learn_from_every_base_span(spark, monkeypatch):
    class Seen(Exception):
        pass

    def spy(kind, rows, made, label, most=3):
        raise Seen(kind, rows.count())

    n = 2500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to u"), "id", F.lit("@b.org now")).alias("text"))
    found = pii.find(docs.withColumn("__key", pii.row_key())).cache()
    monkeypatch.setattr(pii, "variants", spy)
    with pytest.raises(Seen) as seen:
        pii.extra_spans(found)
    assert seen.value.args == ("email", n)
