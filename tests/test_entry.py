import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import connect, differs
from polynym.plans import queries as core

SMALL = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parents[1]
#: One query for each kind; tests/oracle.py runs them all.
SOME = ("normalize_names", "title_normalize", "transliterate_pins", "name_trigrams", "dense_pairs", "lev_negatives", "pairwise_prf", "cluster_prf", "lang_pair_report", "sitelink_pairs")


def test_every_core_query_has_sql():
    assert set(core.queries()) == set(core.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not SMALL.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    assert differs(spark, connect(SMALL), core.queries()[name], core.oracle_sql()[name], str(SMALL)) is None


@pytest.mark.skipif(not SMALL.is_dir(), reason="no tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_llm_folders(tmp_path):
    shutil.copytree(REPO / "polynym", tmp_path / "polynym", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'resolve_labels' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, check=False).returncode == 0


def test_exports():
    import polynym

    assert all(callable(getattr(polynym, name)) for name in polynym.__all__)
