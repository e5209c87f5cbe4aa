"""The entry works without the training-data part, whatever of it is missing."""

import os
import subprocess
import sys

import pytest

CODE = """
import sys
sys.path.insert(0, {repo!r})
for name in {missing!r}:
    sys.modules[name] = None  # import fails
import __spark_entry__ as entry
names = set(entry.queries())
assert "curate_v3" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
assert not any(n.startswith("op") for n in entry.oracle_sql())
from loamsift.session import build
spark = build("local[2]", "entry", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
assert entry.queries()["F02_strip"](
    spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


@pytest.mark.parametrize("missing", [["loamsift.llm", "corpus_pipeline"], ["corpus_pipeline"], ["xxhash"], ["zstandard"]])
def test_entry_without(tmp_path, missing):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = CODE.format(repo=repo, missing=missing)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("fine"), out.stderr[-1500:]
    assert "left out" in out.stderr
