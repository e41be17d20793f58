"""Query plans over the driver tables: name -> (builder, DuckDB SQL or None)."""

from skein.plans import analysis, builds, candidates, functions, ranking, records, relational, signals, streams, temporal, text

_MODULES = (relational, temporal, text, functions, candidates, records, signals, analysis, ranking, streams, builds)
ALL = {name: plan for module in _MODULES for name, plan in module.PLANS.items()}
