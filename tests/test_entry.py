"""The entry points work with and without the optional corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    if Path("/root/testdata/sf0.001").is_dir():
        df = e.entry(spark)
        assert df.count() > 0 and "score" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("without", ["loomsearch/llm", "corpus_pipeline.py"])
def test_the_rest_stands_alone(tmp_path, without):
    import shutil

    shutil.copytree(ROOT / "loomsearch", tmp_path / "loomsearch", ignore=shutil.ignore_patterns("llm", "__pycache__") if "llm" in without else shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import re, __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not [n for n in q if re.match('op[0-9]', n)]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
