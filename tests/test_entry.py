"""The entry works without its optional parts."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, timeout=120)


def test_entry_without_the_optional_subpackage():
    there = os.path.isdir(os.path.join(HERE, "parlance", "llm"))  # it may be deleted
    for missing in ("parlance.llm", "corpus_pipeline", "zstandard"):
        got = run(f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 78 and set(o) <= set(q), len(q)
assert "pipeline" not in q and {there and missing == "corpus_pipeline"} == any(k.startswith("op1_") for k in q)
""")
        assert got.returncode == 0, got.stderr


def test_nothing_else_imports_the_optional_subpackage():
    for folder, _, names in os.walk(os.path.join(HERE, "parlance")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "parlance.llm" not in f.read(), name
