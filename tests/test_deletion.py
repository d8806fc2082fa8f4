"""A tree without the corpus operators' folders still imports, registers and runs everything else."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

#: A path to another tree would show its modules too.
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}

SCRIPT = """
import __spark_entry__ as e
from lodeframe.session import session
names = e.queries()
assert names and not [n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
assert set(e.oracle_sql()) <= set(names)
spark = session("deletion", master="local[2]", shuffle_partitions=2, memory="1g")
print(e.entry(spark).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("gone", [("lodeframe/llm", "tests/llm"), ("lodeframe/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_rest_works_without(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for path in gone:
        if (tree / path).exists():
            shutil.rmtree(tree / path) if (tree / path).is_dir() else (tree / path).unlink()
    script = SCRIPT if "lodeframe/llm" in gone else "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and e.oracle_sql()"
    run = subprocess.run([sys.executable, "-c", script], cwd=tree, env=ENV, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    if "lodeframe/llm" in gone:
        assert run.stdout.strip() == "25"
