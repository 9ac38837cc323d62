"""The entry module without the corpus operators, in copies of the tree."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'mutual_best' in q, 'pipeline' in q, any(x.startswith('op1_') for x in q))"


def shown(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout
    return out.split()[-5:]


@pytest.mark.parametrize("pipeline", [True, False])
def test_engine_without_corpus_operators(tmp_path, pipeline):
    from kinmap.plans.registry import ORACLE_SQL, QUERIES

    shutil.copytree(f"{HERE}/kinmap", tmp_path / "kinmap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{HERE}/corpus_pipeline.py")):
        shutil.copy(f"{HERE}/{name}", tmp_path / name)
    assert shown(tmp_path) == [str(len(QUERIES)), str(len(ORACLE_SQL)), "True", "False", "False"]
