"""The entry's guard: without the llm modules it must import, and its other queries stay."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("memloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert "bm25_topk" in e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for p in (ROOT / "memloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "memloom.llm" not in p.read_text(), p
