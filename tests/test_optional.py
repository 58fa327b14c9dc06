"""The package works without its optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_entry_module_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_a_broken_optional_part_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert found.returncode and "no_such_module" in found.stderr
