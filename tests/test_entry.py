"""Driver contract smoke tests and a fast oracle pass at sf0.001."""
import pytest

import __spark_entry__ as E
from tests.oracle import compare

FAST = ["curated_breakdown", "divsum_ratios", "sanity_chain", "yield_report", "stability_breakdown", "test_split",
        "breakdown_mask", "grid_stability_flags", "score_network", "score_committee", "registry_compose",
        "standardization_minmax", "store_separate_bare", "instance_weights", "signed_log_histogram",
        "outlier_trim_rank", "wide_slices", "name_family_stats"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"ITG", "TEM", "ETG", "n"}


def test_every_sql_query_registered():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 100


@pytest.mark.parametrize("name", FAST)
def test_oracle_fast(spark, sf_small, con_small, name):
    ok, msg = compare(E.queries()[name](spark, sf_small), con_small, E.oracle_sql()[name])
    assert ok, msg


def test_queries_listed_without_a_session():
    """The names can be read in a process that has no Spark session."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                         cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
