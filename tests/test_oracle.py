"""Registered queries vs their DuckDB oracle on the smallest tables, and the
driver entry point."""

import pytest

from .conftest import SF_SMALL
from .oracle_harness import canon, duck

CHEAP = ["pairs_clean", "holdout_split", "mono_corpus", "language_counts", "corpus_audit",
         "language_set_diff", "stable_gid", "three_way_split", "split_sizes", "eval_slice",
         "overlap_check", "seeded_order", "failure_rate", "source_tokens_used", "bleu_corpus",
         "chrf_corpus", "bootstrap_ci", "loss_curve_stats", "latest_point", "pair_run_events",
         "run_manifest", "pending_items", "merge_resumed", "predict_batches", "live_run_index"]


@pytest.fixture(scope="module")
def registry():
    import __spark_entry__ as E
    return E.queries(), E.oracle_sql(), duck(SF_SMALL)


@pytest.mark.parametrize("name", CHEAP)
def test_query_matches_oracle(spark, registry, name):
    qs, sqls, con = registry
    sp = qs[name](spark, SF_SMALL).toPandas()
    dk = con.execute(sqls[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert canon(sp) == canon(dk)


def test_every_oracle_has_a_query(registry):
    qs, sqls, _ = registry
    assert set(sqls) <= set(qs)


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "chrf++" in df.columns
