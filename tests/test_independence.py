"""The library does not need the optional subpackage, and imports without a session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDDEN = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "mnemora.llm" or name.startswith("mnemora.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name="mnemora.llm")
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, check=True)


def test_nothing_else_imports_it():
    files = [p for p in (ROOT / "mnemora").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert not [p for p in files if "mnemora.llm" in p.read_text() or "from .llm" in p.read_text()]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
