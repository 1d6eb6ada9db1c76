"""The entry module without the subpackage for text corpora, or without something that it imports."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_CODE = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith("op") or q == "pipeline" for q in e.queries()))
"""


@pytest.mark.parametrize("name", ["quire.llm", "zstandard", "sentencepiece"])
def test_queries_outlive_a_missing_package(name):
    out = subprocess.run([sys.executable, "-c", _CODE.format(name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, n_sql, corpus = map(int, out.stdout.split())
    assert n - corpus >= 49 and n_sql - corpus <= n - corpus and n >= 49
    if name == "quire.llm":
        assert corpus == 0
