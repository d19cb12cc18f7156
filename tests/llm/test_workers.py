import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {repo!r})
from ragscale.session import build_session
spark = build_session("workers", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
from ragscale.llm.queries import QUERIES
print("rows", QUERIES[{name!r}](spark, {sf_dir!r}).count())
"""


@pytest.mark.parametrize("name, rows", [("op1_language_mixture", 200), ("op4_cotraining", 200), ("op11_hard_negatives", None)])
def test_workers_need_no_copy_of_the_package(tmp_path, sf_dir, name, rows):
    """From a folder without the package, Python workers can't import it: all that tasks use travels with them."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": "/opt/tokenizers:" + ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and p != REPO)}
    script = RUN.format(repo=REPO, name=name, sf_dir=sf_dir)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    count = int(done.stdout.split("rows")[-1])
    assert count == rows if rows else count > 0
