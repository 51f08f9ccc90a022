"""The entry file works with the training-data operators, without them, and with a broken left-over of them."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import builtins, sys
real = builtins.__import__
def guarded(name, *args, **kw):
    if name.startswith({hidden!r}):
        raise ModuleNotFoundError(name)
    return real(name, *args, **kw)
builtins.__import__ = guarded
import __spark_entry__ as E
q, o = E.queries(), E.oracle_sql()
assert "Q6_churn_by_tenure" in q and "Q6_churn_by_tenure" in o and set(o) <= set(q)
print(sum(k.startswith("op") for k in q), "pipeline" in q)
"""


@pytest.mark.parametrize("hidden", ["churnlens.llm", "xxhash", "corpus_pipeline"])
def test_entry_without_a_part(hidden):
    run = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-1500:]
    found, pipeline = run.stdout.split()
    if hidden != "corpus_pipeline":
        assert (found, pipeline) == ("0", "False")
    else:
        assert pipeline == "False"
