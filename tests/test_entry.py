"""The driver contract, also without the llm subpackage, and the command line."""

import os
import shutil
import subprocess
import sys

from tests.test_operators import tone, wav_bytes

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rms' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_batch_extract(spark, tmp_path):
    from tidewave import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav_bytes(tone(440, 8000, 0.3), 8000))
    (tmp_path / "in" / "b.wav").write_text("404: Not Found")
    out = str(tmp_path / "out")
    assert cli.main(["batch-extract", str(tmp_path / "in"), out, "--sample-rate", "8000", "--frame-length", "512", "--hop-length", "256"]) == 0
    rows = spark.read.csv(out, header=True)
    assert rows.count() == 1 and rows.columns == sorted(rows.columns) and "mfcc_mean_0" in rows.columns
    assert cli.main(["batch-extract", str(tmp_path / "in"), out, "--fail-on-error"]) == 1
    assert cli.main(["doctor"]) == 0
