"""Registry of the queries over the driver tables."""

from __future__ import annotations

from skein.plans import ALL

QUERIES = {name: q[0] for name, q in ALL.items()}
ORACLES = {name: q[1] for name, q in ALL.items() if q[1]}
