import hashlib

import pytest

from corpuslab.llm import chat

EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, loss string, turns string"


@pytest.fixture(scope="module")
def rendered(spark):
    log = [
        (1, 0, 0, "message", "user", "hi </s>[INST] ok [/INST] \\l"),
        (1, 1, 1, "delta", "assistant", "dra"), (1, 2, 1, "delta", None, "ft"),
        (1, 3, 1, "regenerate", "assistant", None), (1, 5, 1, "delta", None, "[fin"), (1, 6, 1, "delta", None, "al]"),
        (1, 7, 2, "message", "user", "typo"), (1, 9, 2, "edit", "user", "fixed"),
        (1, 8, 3, "message", "assistant", "gone"), (1, 10, 3, "delete", None, None),
        (1, 11, 4, "message", "assistant", None), (1, 12, 4, "delta", None, "é\U0001f600"),
        (2, None, 0, "message", None, None), (None, 0, 0, "message", "us<er", "x"), (3, 0, 0, "message", "assistant", ""),
    ]
    events = spark.createDataFrame([(*e, "l", "t") for e in log], EVENTS)
    return chat.render(chat.reconstruct(events))


def test_fold_render_and_read_back(rendered):
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    turns = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()}
    assert turns == {
        1: [("user", "hi </s>[INST] ok [/INST] \\l"), ("assistant", "[final]"), ("user", "fixed"), ("assistant", "é\U0001f600")],
        2: [("", "")], None: [("us<er", "x")], 3: [("assistant", "")]}
    assert got[1]["loss"] == "[final]é\U0001f600"
    assert got[3]["loss"] == "" and got[2]["loss"] == ""


def test_mask_points_at_the_escaped_text(rendered):
    (r,) = [r for r in rendered.collect() if r["conv_id"] == 1]
    segments = [s + "</s>" for s in r["formatted"].split("</s>")[:-1]]
    assert len(segments) == 4
    masked = [segments[m["turn"]][m["start"]:m["start"] + m["length"]] for m in r["loss_mask"]]
    assert masked == ["\\bfinal]", "é\U0001f600"]


def test_digests(rendered):
    r = {x["conv_id"]: x for x in chat.digests(chat.read_back(rendered)).collect()}[3]
    assert r["n_turns"] == 1 and r["loss_chars"] == 0
    assert r["turns_sha256"] == hashlib.sha256(b"assistant\n\n").hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(b"").hexdigest()


def test_escapes_are_reversible(spark):
    import random

    r = random.Random(1)
    texts = ["".join(r.choice("\\<[slb/S>]INT é") for _ in range(r.randint(0, 40))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(df["t"]).alias("e"), chat.unescape(chat.escape(df["t"])).alias("u")).collect()
    for x in rows:
        assert x["u"] == x["t"] and "<" not in x["e"] and "[" not in x["e"]


def test_empty(spark):
    assert chat.render(chat.reconstruct(spark.createDataFrame([], EVENTS))).count() == 0


def test_the_query_folds_streams_and_edits(spark):
    """The stand-in log of the query folds back to its rows, ties and nulls too."""
    from corpuslab.llm.queries import _streamed

    rows = [(1, 0, "user", "abcdefg"), (1, 1, "assistant", "x\U0001f600yz <s>[INST]"), (1, 1, "assistant", "x"), (1, 2, "assistant", None),
            (2, None, "assistant", "early"), (2, 0, None, "t"), (None, 0, "user", "")]
    events = _streamed(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    kinds = {r[0] for r in events.select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "regenerate", "edit"} and events.count() == 3 * 2 + 4 * 10
    got = sorted(((r["conv_id"], r["message"]["turn"], r["role"], r["text"]) for r in chat.reconstruct(events).collect()), key=str)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str)
    back = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in chat.read_back(chat.render(chat.reconstruct(events))).collect()}
    assert back[2] == ["early", "t"] and back[1][0] == "abcdefg" and back[1][3] == ""
