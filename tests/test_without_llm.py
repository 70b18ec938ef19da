"""The rest stands without the folder of training-data operators."""
import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_without_the_folders(tmp_path):
    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "freqforge", tmp_path / "freqforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(s) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
