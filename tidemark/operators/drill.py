"""A rehearsal of recovery: clone, back up, verify from another trust domain, restore beside, reopen, compare."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from tidemark.operators import backup
from tidemark.operators.store import Files, Store


def run(spark: SparkSession, live: str, work: str, tenant: str, signer, directory, reopen: Callable[[str], Store], role: str = "backup", notify: Callable[[dict], None] | None = None) -> dict:
    """A receipt of the drill. Only work is written to, and it must not be there yet nor lie in the live store.

    directory: trust roots of those who verify, apart from the signer. reopen: opens the restored store as production
    would. A step that raises fails the drill, and later ones that need it count as failed; notify gets every receipt.
    """
    files, began = Files(spark, work), int(time.time() * 1000)
    inside = lambda p, q: (p.rstrip("/") + "/").startswith(q.rstrip("/") + "/")
    if inside(work, live) or inside(live, work) or files.fs.exists(files._path(work)):
        raise ValueError("a drill works beside the live store, in a new folder")
    clone, kept, restored = (f"{work}/{x}" for x in ("clone", "backup", "restored"))
    state: dict = {}

    def copy() -> bool:
        source, conf = Files(spark, live), spark.sparkContext._jsc.hadoopConfiguration()
        return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source.fs, source._path(live), files.fs, files._path(clone), False, conf)

    def restore() -> bool:
        root = directory.resolve(role, backup.signature(spark, kept)["key_id"])
        backup.restore(spark, kept, restored, tenant, directory._verify, root.public_key)
        return True

    def open_again() -> bool:
        state["was"], state["is"] = reopen(clone), reopen(restored)
        return True

    steps = {
        "1 clone": copy,
        "2 backup": lambda: backup.create(spark, clone, kept, tenant, signer)["files"] > 0,
        "3 verified apart": lambda: backup.verify_with(spark, kept, tenant, directory, role).isEmpty(),
        "4 restored beside": restore,
        "5 reopened": open_again,
        "6 same heads": lambda: state["is"].log.refs["branches"] == state["was"].log.refs["branches"],
        "7 intact": lambda: all(state["is"].verify_integrity().values()),
    }
    checks: dict[str, bool] = {}
    for name, step in steps.items():
        try:
            checks[name] = bool(step())
        except Exception:
            checks[name] = False
    receipt = backup.receipt("drill", began, int(time.time() * 1000), checks)
    if notify is not None:
        notify(receipt)
    return receipt
