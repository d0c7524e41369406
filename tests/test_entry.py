import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_stands_without_the_text_operators(tmp_path):
    """A copy without the llm folders imports, with and without corpus_pipeline.py, and lists the other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    tell = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k[:2] == 'op' or k == 'pipeline' for k in q), len(set(e.oracle_sql()) - set(q)))"
    for without in ([], ["corpus_pipeline.py"]):
        for name in without:
            (copy / name).unlink(missing_ok=True)
        out = subprocess.run([sys.executable, "-c", tell], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
        assert int(out[0]) >= 41 and out[1:] == ["0", "0"]
