"""corpuslab — parallel-corpus preparation and translation-quality evaluation
on Spark DataFrames.

Sub-packages:
  sources/    readers and writers (CSV corpora, run trees, JSON, logs)
  functions/  column expressions: cleaning, tokenisers, small Arrow helpers
  operators/  relational operators: splits, metrics, bootstrap, reports, run logs
  plans/      stand-in views over the test tables and the registered queries
  streaming/  Structured Streaming twins of the live views
"""

from corpuslab.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
