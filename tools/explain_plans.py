"""Print the physical plan (operator tree, scan schemas, pushed filters) of
registered queries after running them once.

usage: python tools/explain_plans.py [sf_dir] query [query ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    from docmill.plans.registry import QUERIES
    from docmill.session import get_session
    spark = get_session("local[8]", 8)
    for name in args or ["chunks", "retrieve_lexical", "retrieve_dense", "order_totals", "page_selectors"]:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()   # final adaptive plan
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        print(f"===== {name}")
        print(text.split("\n\n\n")[0])
        for line in re.findall(r"(ReadSchema: [^\n]+|PushedFilters: [^\n]+)", text):
            print("   ", line)


if __name__ == "__main__":
    main()
