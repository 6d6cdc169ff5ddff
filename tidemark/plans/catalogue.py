"""The query catalogue: every registered query with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import belief, governance, graphs, recollection, versioning

MODULES = (belief, versioning, graphs, recollection, governance)

#: Whole numbers that may be missing are shown as -1 in results, which all engines print alike.
OPEN = {
    "interval_contains": ["valid_end"],
    "claim_history_close": ["known_end"],
    "history_lookup": ["known_end"],
    "interval_builders": ["from_end", "between_end"],
    "point_lookup": ["counter"],
    "branch_scan_latest": ["counter"],
    "read_at_commit": ["counter"],
    "rewind_state": ["old_counter", "new_counter"],
    "branch_visibility_after_fork": ["on_fork", "at_fork"],
    "merge_three_way": ["counter"],
    "merge_claims": ["valid_start"],
    "recall_plan": ["depth"],
    "label_propagation": ["label"],
}


def _shown(name: str, run):
    def query(spark, sf_dir):
        return run(spark, sf_dir).withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in OPEN[name]})

    query.__name__, query.__doc__ = run.__name__, run.__doc__
    return query


def queries() -> dict:
    return {name: _shown(name, run) if name in OPEN else run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for m in MODULES for name, sql in m.SQL.items()}
    for name, columns in OPEN.items():
        found[name] = f"SELECT * REPLACE ({', '.join(f'coalesce({c}, -1) AS {c}' for c in columns)}) FROM ({found[name]})"
    return found
