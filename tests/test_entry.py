import subprocess
import sys

from tests.conftest import ROOT


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    n, known = out.stdout.split()[-2:]
    assert int(n) > 90 and known == "True", out.stderr
