"""The driver contract: names, SQL and the subpackage that may be missing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def without(names: str, then: str) -> int:
    """Import the entry file as if modules were missing, and run ``then``; the exit code."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name in {names.split()!r}:\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"import __spark_entry__ as e\n{then}\n"
    )
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, timeout=120, stderr=subprocess.DEVNULL).returncode


def test_entry_without_the_corpus_operators():
    """As if their folder and the pipeline were deleted."""
    assert without("dateloom.llm corpus_pipeline", "assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']") == 0


def test_other_missing_modules_are_not_passed_over():
    assert without("numpy", "") != 0
    assert without("dateloom.llm.simhash", "") != 0 or not (REPO / "dateloom" / "llm").exists()
