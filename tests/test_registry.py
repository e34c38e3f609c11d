"""The registry, and that the engine needs none of the corpus operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from cellweave.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) > 80


def test_the_engine_does_not_import_the_corpus_operators():
    code = "import sys, cellweave.plans.registry as r; r.queries(); assert not any(m.startswith('cellweave.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=120).returncode == 0
    for path in (ROOT / "cellweave").rglob("*.py"):
        assert "llm" in path.parts or "cellweave.llm" not in path.read_text()
