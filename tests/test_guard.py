"""The rest of the library stands without the optional subpackage and the pipeline."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("burstline.llm"):
            raise ModuleNotFoundError(name, name=name)

sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_the_optional_parts():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "burstline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "burstline.llm" not in path.read_text(), path
