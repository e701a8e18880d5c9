"""Checks the queries of the given plan modules: check_modules.py module ..."""

from __future__ import annotations

import sys

import check

if __name__ == "__main__":
    from flowlens.plans import REGISTRY

    parts = sys.argv[1:]
    picked = [n for n, q in REGISTRY.items() if q.build.__module__.rsplit(".", 1)[-1] in parts]
    for n in list(REGISTRY):
        if n not in picked:
            del REGISTRY[n]
    sys.argv = ["check.py"]
    sys.exit(check.main())
