"""The entry point keeps the core queries whatever the optional part lacks."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

BLOCK = """
import importlib.abc, sys
class Block(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError("blocked", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
from tidemark.catalog import REGISTRY
assert set(REGISTRY) <= set(e.queries()) and not any(n.startswith("op1_") for n in e.queries()), sorted(e.queries())[:5]
assert set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize("name", ["ahocorasick", "xxhash", "public_tokenizers", "tidemark.llm", "corpus_pipeline"])
def test_core_queries_stay_without(name):
    root = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCK.format(name=name)], cwd=root, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(root)}, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
