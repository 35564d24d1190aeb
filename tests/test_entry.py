"""The driver entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = ("import __spark_entry__ as E; q, s = E.queries(), E.oracle_sql(); "
       "assert 'score_runs' in q and set(s) <= set(q); "
       "assert not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), sorted(q)")


def test_queries_without_the_llm_folder(tmp_path):
    """The reference side loads with ``llm`` gone, whether or not the pipeline
    script still lies beside it."""
    for with_pipeline in (True, False):
        copy = tmp_path / str(with_pipeline)
        shutil.copytree(os.path.join(ROOT, "corpuslab"), copy / "corpuslab",
                        ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
            if os.path.exists(os.path.join(ROOT, name)):
                shutil.copy(os.path.join(ROOT, name), copy)
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        run = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=env, capture_output=True, text=True)
        assert run.returncode == 0, run.stderr
