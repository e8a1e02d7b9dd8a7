import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

TOP = Path(entry.__file__).resolve().parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_corpus_operators(tmp_path, pipeline):
    """pipeline: corpus_pipeline.py stays where it can be found, while what it needs is gone."""
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("import boundwise.llm.common\n")
    shutil.copytree(TOP / "boundwise", tmp_path / "boundwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert ran.returncode == 0, ran.stderr
    from boundwise.plans import catalogue

    assert ran.stdout.splitlines() == [" ".join(sorted(catalogue.queries())), " ".join(sorted(catalogue.oracle_sql()))]


def test_what_the_corpus_operators_miss_is_an_error(tmp_path):
    shutil.copy(TOP / "__spark_entry__.py", tmp_path)
    shutil.copytree(TOP / "boundwise", tmp_path / "boundwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "boundwise/llm").mkdir()
    (tmp_path / "boundwise/llm/__init__.py").touch()
    (tmp_path / "boundwise/llm/queries.py").write_text("from . import absent\n")
    ran = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert "absent" in ran.stderr


def test_nothing_else_imports_the_corpus_operators():
    for path in (TOP / "boundwise").rglob("*.py"):
        if "llm" not in path.relative_to(TOP).parts:
            assert "llm" not in path.read_text(), path
