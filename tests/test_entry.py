"""The entry module without the optional parts."""

import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
for name in {blocked}:
    sys.modules[name] = None
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""


def test_other_queries_stay_without_the_optional_parts():
    from docmill.plans.oracle import ORACLE_SQL
    from docmill.plans.registry import QUERIES
    want = f"{len(QUERIES)} {len(set(ORACLE_SQL) & set(QUERIES))}"
    for blocked in (["public_tokenizers"], ["docmill.llm"], ["corpus_pipeline"]):
        out = subprocess.run([sys.executable, "-c", CODE.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
        assert out.stdout.strip() == want, out.stderr
