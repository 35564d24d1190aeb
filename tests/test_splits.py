"""Exact ranks and split sizes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslab.operators import corpus as C
from corpuslab.operators import partition as P

# published per-language corpus sizes -> train / dev / test
GOLDEN = {"Bhili": (22500, 15750, 2250, 4500), "Gondi": (15829, 11080, 1583, 3166),
          "Mundari": (23154, 16208, 2315, 4631), "Santali": (15000, 10500, 1500, 3000)}


def _corpus(spark, sizes):
    parts = [spark.range(n).select(F.lit(lang).alias("language"), F.col("id").alias("doc_id"))
             for lang, n in sizes.items()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def test_golden_split_sizes(spark):
    df = _corpus(spark, {k: v[0] for k, v in GOLDEN.items()})
    sizes = {r["language"]: (r["train"], r["dev"], r["test"])
             for r in C.split_sizes(P.three_way_split(df, "language", "doc_id")).collect()}
    assert sizes == {k: v[1:] for k, v in GOLDEN.items()}


def test_half_even_ties(spark):
    sizes = {r["language"]: (r["train"], r["dev"], r["test"])
             for r in C.split_sizes(P.three_way_split(_corpus(spark, {"a": 5, "b": 15}), "language", "doc_id")).collect()}
    assert sizes["a"][0] == 4 and sizes["b"][0] == 10
    assert sum(sizes["a"]) == 5 and sum(sizes["b"]) == 15


def test_exact_rank_matches_plain_window_under_skew(spark):
    # one language holds most rows: the bucketed rank must equal the plain window
    df = _corpus(spark, {"hot": 20000, "x": 300, "y": 7})
    r = P.seeded_rank(df, "language", "doc_id", 42, buckets=64)
    h = P.seeded_key(42, "language", "doc_id")
    w = Window.partitionBy("language").orderBy(h, "doc_id")
    plain = df.select("language", "doc_id", F.row_number().over(w).cast("long").alias("rank0"))
    bad = r.join(plain, ["language", "doc_id"]).filter(F.col("rank") != F.col("rank0")).count()
    assert bad == 0
    assert r.count() == 20307


def test_holdout_counts_and_gid(spark):
    df = _corpus(spark, {"a": 100, "b": 41})
    h = P.holdout_split(df, "language", "doc_id", 0.15, 7)
    got = {(r[0], r[1]): r[2] for r in h.groupBy("language", "part_name").count().collect()}
    assert got[("a", "pretrain")] == 85 and got[("b", "pretrain")] == 34
    g = P.stable_gid(df, "language", ("doc_id",))
    assert sorted(r[0] for r in g.filter("language = 'b'").select("gid").collect())[:2] == ["b_0", "b_1"]
    assert g.filter("language = 'b' AND doc_id = 40").first()["gid"] == "b_40"


def test_overlap_zero_and_determinism(spark):
    df = _corpus(spark, {"a": 500})
    s1 = P.three_way_split(df, "language", "doc_id", seed=3)
    s2 = P.three_way_split(df, "language", "doc_id", seed=3)
    assert C.overlap_check(s1.withColumnRenamed("doc_id", "gid")).first()[0] == 0
    assert s1.select("doc_id", "split").exceptAll(s2.select("doc_id", "split")).count() == 0


def test_natural_rank_with_an_outlying_id(spark):
    df = spark.range(20_000).select(F.lit("a").alias("language"), F.when(F.col("id") == 0, 10 ** 15)
                                    .otherwise(F.col("id") * 3).cast("long").alias("doc_id"))
    d = P.with_range_bucket(df, "doc_id", 64, "b")
    assert d.groupBy("b").count().agg(F.max("count")).first()[0] < 1000  # no bucket has it all
    g = {r.doc_id: r.gid for r in P.stable_gid(df, "language", ("doc_id",)).collect()}
    assert [g[i] for i in sorted(g)] == [f"a_{n}" for n in range(20_000)]


def test_building_a_split_starts_no_job(spark):
    df = _corpus(spark, {"a": 500}).repartition(4).distinct()
    tracker, group = spark.sparkContext.statusTracker(), "split-plan"
    spark.sparkContext.setJobGroup(group, group)
    out = P.three_way_split(P.stable_gid(df, "language", ("doc_id",)), "language", "gid")
    before = len(tracker.getJobIdsForGroup(group))
    assert out.count() == 500
    spark.sparkContext.setJobGroup("rest", "rest")
    assert before == 0


def test_layouts_are_permutations(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 40).alias("length"))
    pos = [r.position for r in P.seeded_order(df, "doc_id", 5).collect()]
    assert sorted(pos) == list(range(1, 3001))
    rows = P.length_buckets(df, "length", 16, 5, "doc_id").collect()
    for bucket in range(3):
        own = [r.position for r in rows if r.length_bucket == bucket]
        assert sorted(own) == list(range(1, len(own) + 1))
