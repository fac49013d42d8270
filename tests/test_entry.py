"""The entry module without the optional package."""

import pathlib
import shutil
import subprocess
import sys

REPO = pathlib.Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q))"


def counted(folder: pathlib.Path) -> list[int]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return [int(x) for x in done.stdout.split()[-2:]]


def test_other_queries_stay_when_the_package_is_deleted(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json")
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(REPO, copy, ignore=left_out)
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        total, optional = counted(copy)
        assert optional == 0
        assert total >= 207
