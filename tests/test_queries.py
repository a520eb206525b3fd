"""Every query with SQL against DuckDB; the others run and keep their rows."""

import pytest

from quillmere.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.compare import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    same_rows(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_probes_on_held_out_labels(spark):
    """Held-out documents against their labels: better than the commonest class or the mean."""
    sf = "/root/testdata/sf0.1"
    binary, regression, ordinal = (QUERIES[f"probe_{k}"](spark, sf).collect() for k in ("binary", "regression", "ordinal"))
    share = sum(r.y for r in binary) / len(binary)
    right = sum((r.p >= 0.5) == (r.y == 1) for r in binary) / len(binary)
    mean = sum(r.z for r in regression) / len(regression)
    left = sum((r.z - r.p) ** 2 for r in regression) / sum((r.z - mean) ** 2 for r in regression)
    common = max(sum(r.level == k for r in ordinal) for k in {r.level for r in ordinal}) / len(ordinal)
    hit = sum(r.level == r.p for r in ordinal) / len(ordinal)
    assert right > max(share, 1 - share) + 0.05 and left < 0.7 and hit > common + 0.03, (right, share, left, hit, common)


def test_trees_on_held_out_labels(spark):
    rows = QUERIES["probe_trees"](spark, "/root/testdata/sf0.1").collect()
    share = sum(r.y for r in rows) / len(rows)
    assert all(0 <= r.p <= 1 for r in rows)
    assert sum((r.p >= 0.5) == (r.y == 1) for r in rows) / len(rows) > max(share, 1 - share) + 0.05


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert FLAGSHIP in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_package(tmp_path):
    """The entry still imports when that package and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quillmere", tmp_path / "quillmere", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
