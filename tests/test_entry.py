import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_flagship(spark):
    assert len(entry.entry(spark).collect()) == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_a_library_of_the_subpackage():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert said.stdout.split()[-1:] == [str(len(entry.catalogue.QUERIES))] or entry.llm_catalogue is None


def test_the_rest_stands_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "keystrata"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "keystrata/llm", ignore_errors=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(entry.catalogue.QUERIES)), "False"]
