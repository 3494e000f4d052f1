"""The registry, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout


def test_registry_without_the_subpackage():
    names = run("import sys; sys.modules['lagframe.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries())").split()
    assert "delay_monthly" in names and "xml_scan" in names and not any(n.startswith("op") for n in names)


def test_every_sql_twin_has_a_query():
    assert run("import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()))").strip() == "True"


def test_entry(spark):
    from lagframe.plans.queries import QUERIES

    assert "delay_monthly" in QUERIES
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["month", "n", "mean_acc_delay", "mean_pub_delay"] and df.count() > 0
