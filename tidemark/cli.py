"""Operator commands: python -m tidemark.cli COMMAND ...; each prints one JSON object and fails with exit code 1.

A store is looked at and never changed; backups and restores go to new folders; pruning is a dry run unless --apply is
given. With --metrics-file, figures of the run are written there, of a failed one too.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backup, custody
from tidemark.operators.security import Issuer, KeyDirectory, SoftwareSigner, TrustRoot, verifier
from tidemark.operators.store import Files, RefLog, Store

#: What a seeded record takes on disk, about, and what has to stay free.
BYTES_PER_RECORD, HEADROOM = 4_096, 1 << 30


def branches(spark: SparkSession, root: str) -> dict:
    return {"branches": RefLog(Files(spark, root), f"{root}/refs").refs["branches"]}


def manifest(spark: SparkSession, root: str) -> dict:
    files = backup.manifest(spark, root)
    r = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return {"files": r["files"], "bytes": r["bytes"], "size": backup.human_bytes(r["bytes"])}


def retention(spark: SparkSession, table: str, minimum: int, recent_after: int) -> dict:
    """Counts of decisions over a table of (root, backup, created, held)."""
    plan = custody.retention(spark.read.parquet(table), minimum, recent_after)
    return {r["decision"]: r["n"] for r in plan.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}


def flat(samples: list[float], tolerance: float = 0.1) -> bool:
    """Whether a series of memory samples stays level: the later half's median within a tolerance of the earlier one's."""
    half = len(samples) // 2
    if half < 2:
        return False
    middle = lambda xs: sorted(xs)[len(xs) // 2]
    return middle(samples[half:]) <= middle(samples[:half]) * (1 + tolerance)


def preflight(records: int, free_bytes: int) -> None:
    """Raises if so many records would not fit into what is free."""
    needed = records * BYTES_PER_RECORD + HEADROOM
    if needed > free_bytes:
        raise OSError(f"{records} records need {backup.human_bytes(needed)}, {backup.human_bytes(free_bytes)} are free")


def inspect(spark: SparkSession, root: str, tenant: str) -> dict:
    refs = RefLog(Files(spark, root), f"{root}/refs").refs
    return {"tenant": tenant, "branches": len(refs["branches"]), "tags": len(refs["tags"]), "commits": len(refs["commits"]), **manifest(spark, root)}


def verify(spark: SparkSession, root: str, tenant: str) -> dict:
    """Whether each reachable commit has the records that were published. Refuses a place where no store is."""
    files = Files(spark, root)
    if not files.fs.exists(files._path(f"{root}/refs")):
        raise FileNotFoundError(root)
    issuer = Issuer(SoftwareSigner(spark, "none"), verifier(spark), tenant)
    found = Store(spark, root, issuer).verify_integrity()
    return {"commits": len(found), "damaged": sorted(c for c, good in found.items() if not good), "passed": all(found.values())}


def _signer(spark: SparkSession, path: str, key_id: str) -> SoftwareSigner:
    private, public = open(path).read().split()
    return SoftwareSigner(spark, key_id, (private, public))


def _register(spark: SparkSession, path: str) -> KeyDirectory:
    with open(path) as f:
        return KeyDirectory.from_json(f.read(), verifier(spark))


def _write(path: str, text: str) -> None:
    """Whole or not at all."""
    with open(f"{path}.part", "w") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def _checked(spark: SparkSession, a: argparse.Namespace) -> dict:
    target = a.path or backup.newest(spark, a.shelf)
    if a.trust_roots:
        differ = backup.verify_with(spark, target, a.tenant, _register(spark, a.trust_roots), a.role)
    else:
        differ = backup.verify(spark, target, a.tenant, verifier(spark), open(a.public_key_file).read().strip())
    n = differ.count()
    return {"backup": target, "differing": n, "passed": n == 0}


def _restored(spark: SparkSession, a: argparse.Namespace) -> dict:
    target = a.path or backup.newest(spark, a.shelf)
    key = _register(spark, a.trust_roots).resolve(a.role, backup.signature(spark, target)["key_id"]).public_key if a.trust_roots else open(a.public_key_file).read().strip()
    backup.restore(spark, target, a.out, a.tenant, verifier(spark), key)
    return {"backup": target, "restored": a.out}


def _pruned(spark: SparkSession, a: argparse.Namespace) -> dict:
    holds = json.load(open(a.legal_hold_file)) if a.legal_hold_file else {}
    return {"applied": a.apply, "decisions": backup.prune(spark, a.shelf, a.keep_days * 86_400_000, a.minimum_copies, holds, apply=a.apply)}


def keys(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Changes go to the register file, whole, after they have been checked."""
    d = _register(spark, a.trust_roots) if os.path.exists(a.trust_roots) else KeyDirectory(verifier(spark))
    if a.verb == "expand":
        key = open(a.public_key_file).read().strip()
        d.add(TrustRoot(a.key_id, a.role, key, a.generation, approvals=frozenset(a.approver), ceremony=a.ceremony))
    elif a.verb == "activate":
        d.activate(a.role, a.key_id)
    elif a.verb == "retire":
        d.retire(a.role, a.key_id)
    elif a.verb == "revoke":
        d.revoke(a.role, a.key_id, a.reason, a.seal_role)
    elif a.verb == "drill":
        challenge = os.urandom(32)
        root = d.signing_root(a.role)
        d.verify(a.role, challenge, _signer(spark, a.signing_key_file, root.key_id).sign(challenge), root.key_id)
        return {"signs": root.key_id, "passed": True}
    if a.verb != "inspect":
        d.validate()
        _write(a.trust_roots, d.to_json())
    return {"roots": [{"key_id": r.key_id, "role": r.role, "generation": r.generation, "status": r.status} for r in d.roots()], "sealed": sorted(d.sealed)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("--metrics-file")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str) -> argparse.ArgumentParser:
        """Options by name; a question mark makes one optional."""
        c = sub.add_parser(name)
        for o in options:
            c.add_argument(f"--{o.rstrip('?')}", required=not o.endswith("?"))
        return c

    for name in ("branches", "manifest"):
        sub.add_parser(name).add_argument("root")
    r = sub.add_parser("retention")
    r.add_argument("table")
    r.add_argument("--minimum", type=int, default=2)
    r.add_argument("--recent-after", type=int, default=0)
    command("inspect", "path", "tenant")
    command("verify", "path", "tenant")
    command("backup", "path", "tenant", "out?", "shelf?", "signing-key-file", "key-id")
    for name in ("verify-backup", "restore"):
        c = command(name, "path?", "shelf?", "tenant", "trust-roots?", "public-key-file?", *(["out"] if name == "restore" else []))
        c.add_argument("--role", default="backup")
    c = command("backup-prune", "shelf", "legal-hold-file?")
    c.add_argument("--keep-days", type=int, required=True)
    c.add_argument("--minimum-copies", type=int, required=True)
    c.add_argument("--apply", action="store_true")
    c = command("preflight", "path")
    c.add_argument("--records", type=int, required=True)
    c = command("keys", "trust-roots", "role?", "key-id?", "public-key-file?", "signing-key-file?", "ceremony?", "reason?")
    c.add_argument("verb", choices=["inspect", "expand", "activate", "retire", "revoke", "drill"])
    c.add_argument("--generation", type=int)
    c.add_argument("--approver", action="append", default=[])
    c.add_argument("--seal-role", action="store_true")
    return p


def _backed_up(spark: SparkSession, a: argparse.Namespace) -> dict:
    target = a.out or f"{a.shelf}/{a.tenant}-{int(time.time() * 1000)}"
    return {"backup": target, **backup.create(spark, a.path, target, a.tenant, _signer(spark, a.signing_key_file, a.key_id))}


def _preflighted(a: argparse.Namespace) -> dict:
    free = shutil.disk_usage(a.path).free
    preflight(a.records, free)
    return {"records": a.records, "free": backup.human_bytes(free), "passed": True}


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], dict]] = {
    "branches": lambda s, a: branches(s, a.root),
    "manifest": lambda s, a: manifest(s, a.root),
    "retention": lambda s, a: retention(s, a.table, a.minimum, a.recent_after),
    "inspect": lambda s, a: inspect(s, a.path, a.tenant),
    "verify": lambda s, a: verify(s, a.path, a.tenant),
    "backup": _backed_up,
    "verify-backup": _checked,
    "restore": _restored,
    "backup-prune": _pruned,
    "preflight": lambda _, a: _preflighted(a),
    "keys": keys,
}


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark, began = SparkSession.builder.appName("tidemark").getOrCreate(), time.time()
    try:
        out = COMMANDS[a.command](spark, a)
    except Exception as e:
        out = {"error": type(e).__name__, "message": str(e)[:300], "passed": False}
    passed = out.get("passed", True)
    took = int((time.time() - began) * 1000)
    if a.metrics_file:
        _write(a.metrics_file, backup.metrics_text({"passed": int(passed), "took_ms": took}))
    print(json.dumps({"command": a.command, "took_ms": took, **out}))
    return 0 if passed else 1


if __name__ == "__main__":
    raise SystemExit(main())
