import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars long, text string, g string, payload string, `a.b` string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def proof(tree, at, arity):
    steps = []
    for row in tree[:-1]:
        lo = at // arity * arity
        run = row[lo:lo + arity]
        steps.append(("".join(run[:at - lo]), "".join(run[at - lo + 1:])))
        at //= arity
    return steps


def brute(rows, arity):
    """{sorted list of (doc_id, leaf, subroot, root, witness)}, plainly."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], h(*[field(v) for v in r])))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by_source[s]], arity)
    top = levels([trees[s][-1][0] for s in names], arity)
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf) in enumerate(by_source[s]):
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof(trees[s], i, arity) + proof(top, k, arity)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "x") for r in rows], DOC)


def got(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [(w["left"], w["right"]) for w in r["witness"]]) for r in df.collect()]


def key(r):
    return str(r)


def random_rows(sizes, seed=1):
    r = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        rows += [(i, s, r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "a\nb", "ü" * r.randrange(9), "x" * 5000]))
                 for i in r.sample(range(10 ** 6), n)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity,height", [(3, 1), (3, 2), (2, 3), (3, 7)])
def test_manifest_equals_brute_force(spark, arity, height):
    """Small blocks: several rounds of block roots; a hot source; single rows."""
    rows = random_rows({"hot": 100, "b": 28, "c": 9, "é": 3, "z": 1, "Z": 2, "": 4, None: 5})
    rows += [(None, "b", None, None, None)] * 3 + [(7, "c", "en", 1, "t"), (7, "c", "en", 1, "t"), (7, "c", "de", 1, "t")]
    found = got(merkle.manifest(frame(spark, rows), arity, height))
    assert sorted(found, key=key) == sorted(brute(rows, arity), key=key)


def test_many_sources_of_one_row(spark):
    rows = [(i, f"s{i}", "en", 1, "t") for i in range(60)]
    assert sorted(got(merkle.manifest(frame(spark, rows), 3, 1)), key=key) == sorted(brute(rows, 3), key=key)


def test_one_row_and_none(spark):
    one = [(1, "s", None, None, "x")]
    (row,) = got(merkle.manifest(frame(spark, one), 3))
    assert row == (1, h(*map(field, one[0])), row[1], row[1], [])
    assert got(merkle.manifest(frame(spark, []), 3)) == []


def test_a_changed_leaf_is_caught(spark):
    rows = random_rows({"a": 40, "b": 7})
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, merkle.leaf(text=F.translate("text", "\n", "")))
    out = merkle.verify(merkle.manifest(frame(spark, rows), 3, 2, other=claimed).withColumn(
        "claimed", F.coalesce("other", "leaf")), "claimed").collect()
    text = {r[0]: r[4] for r in rows}
    for x in out:
        changed = zlib.crc32(str(x["doc_id"]).encode()) % 2 == 0 and "\n" in (text[x["doc_id"]] or "")
        assert x["verified"] is not changed
        fold = x["claimed"]
        for w in x["witness"]:
            fold = h(w["left"], fold, w["right"])
        assert fold == x["folded_root"]
    assert {x["verified"] for x in out} == {True, False}


def test_an_open_tree_extends_witnesses_as_siblings_arrive():
    leaves = [h(str(i)) for i in range(20)]
    tree = merkle.OpenTree(3, 3)
    for i, x in enumerate(leaves):
        tree.append(x)
        if i == 1:
            assert tree.witness == [[], []]
        if i == 2:
            assert tree.witness[0] == [("", leaves[1] + leaves[2])] and tree.witness[2] == [(leaves[0] + leaves[1], "")]
    whole = levels(leaves, 3)
    assert tree.finish() == whole[-1][0]
    assert tree.witness == [proof(whole, i, 3) for i in range(20)]
