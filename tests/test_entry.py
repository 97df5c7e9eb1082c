"""Driver contract: entry runs, every query has a stable schema on sf0.001, oracle keys are registered."""

import pytest

import __spark_entry__ as E

from conftest import SF

FAST = ["related_docs", "distance_recall", "normalize_text", "flag_outdated", "tfidf", "scorecard", "threshold_sweep",
        "candidate_pairs", "topk_chunks_vector", "corpus_select", "quota_report", "decode_errors", "render_templates"]


def test_entry_runs(spark):
    df = E.entry(spark)
    row = df.collect()[0]
    assert df.columns == ["recall", "recall_without_tabular", "avg_comparisons"] and 0 <= row["recall"] <= 1


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 70


BARE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import glob, zipfile
glob.glob = zipfile.ZipFile = None  # no look at installed files
import warnings
warnings.simplefilter("ignore")
import __spark_entry__ as E
q, s = E.queries(), E.oracle_sql()
assert "tfidf" in q and "tfidf" in s and set(s) <= set(q)
assert "pyspark.core.context" not in sys.modules or sys.modules["pyspark.core.context"].SparkContext._active_spark_context is None
"""


@pytest.mark.parametrize("hidden", [(), ("zstandard",), ("tokenizers",), ("public_tokenizers",), ("regex",)])
def test_registry_needs_no_session_no_jar_and_no_extra(hidden):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(E.__file__))
    got = subprocess.run([sys.executable, "-c", BARE.format(hidden=hidden)], cwd=root, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from staleguard.config import ENGLISH_STOP_WORDS
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from staleguard.sources.tables import TABLES, table_path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", FAST)
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(E.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([plain(v) for v in r]) for r in res.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect()) == want


AUDITED = ["related_docs", "distance_recall", "threshold_sweep", "candidate_pairs", "cluster_recall",
           "avg_related", "shared_cluster", "cumulative_select", "flag_outdated", "contains_type",
           "retrieve_context", "scorecard", "kmeans"]


@pytest.mark.parametrize("name", AUDITED)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
