"""The library stands without its optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_optional_subpackage():
    for path in (ROOT / "seqweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "seqweave.llm" not in path.read_text(), path


def test_entry_without_it():
    code = "import sys; sys.modules['seqweave.llm'] = None; import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
