"""Backups: a copy of the store beside a signed manifest; verified before it is restored, never over anything."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import custody
from tidemark.operators.custody import verify_manifest
from tidemark.operators.security import Refused
from tidemark.operators.store import Files

FORMAT = 2


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, bytes, digest) of every file, read and hashed by the executors."""
    base = Files(spark, root)
    top = base._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base._path(root)).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # A local path comes as file:/x from one side and file:///x from the other.
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    relative = F.substr(plain(F.col("path")), F.length(plain(F.lit(top))) + 2)
    return files.select(relative.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


def _summary(files: DataFrame) -> dict:
    """A digest over all lines of a manifest that doesn't depend on their order, so they never meet in one task."""
    line = F.sha2(F.concat_ws("|", "path", F.col("bytes").cast("string"), "digest"), 256)
    parts = [F.coalesce(F.bit_xor(F.conv(F.substr(line, F.lit(1 + 15 * k), F.lit(15)), 16, 10).cast("long")), F.lit(0)).alias(f"x{k}") for k in range(4)]
    r = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), *parts).first()
    return {"files": r["files"], "bytes": r["bytes"], "lines": "".join(f"{r[f'x{k}']:015x}" for k in range(4))}


def create(spark: SparkSession, root: str, target: str, tenant: str, signer, now_ms: int | None = None) -> dict:
    """Copies a store into target/data, writes its manifest, and signs it last; an unfinished copy has another name."""
    files = Files(spark, target)
    if files.fs.exists(files._path(target)):
        raise FileExistsError(target)
    part = f"{target}.partial-{uuid.uuid4().hex[:8]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files.fs.mkdirs(files._path(part))
    source = Files(spark, root)
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.fs, source._path(root), files.fs, files._path(f"{part}/data"), False, conf)
    held = manifest(spark, f"{part}/data")
    held.write.parquet(f"{part}/manifest")
    head = {"format_version": FORMAT, "tenant": tenant, "created_ms": int(time.time() * 1000) if now_ms is None else now_ms, **_summary(held)}
    signed = {"head": head, "key_id": signer.key_id, "signature": signer.sign(json.dumps(head, sort_keys=True).encode())}
    files.create(f"{part}/signature.json", json.dumps(signed))
    files.fs.rename(files._path(part), files._path(target))
    return head


def signature(spark: SparkSession, target: str) -> dict:
    return json.loads(Files(spark, target).read(f"{target}/signature.json"))


def verify_with(spark: SparkSession, target: str, tenant: str, directory, role: str = "backup") -> DataFrame:
    """As verify(), by the root that the backup names, if a key directory still trusts it."""
    return verify(spark, target, tenant, directory._verify, directory.resolve(role, signature(spark, target)["key_id"]).public_key)


def survey(spark: SparkSession, shelf: str, holds: dict[str, str] | None = None) -> DataFrame:
    """(root, backup, created, held) of the backups on a shelf; whatever else lies there is left out."""
    files = Files(spark, shelf)
    rows = []
    for name in files.names(shelf):
        if ".partial-" not in name and files.fs.exists(files._path(f"{shelf}/{name}/signature.json")):
            rows.append((shelf, name, int(signature(spark, f"{shelf}/{name}")["head"].get("created_ms", 0)), name in (holds or {})))
    return spark.createDataFrame(rows, "root string, backup string, created long, held boolean")


def newest(spark: SparkSession, shelf: str) -> str:
    """The newest backup on a shelf. An empty shelf is an error: nothing to verify isn't a passed verification."""
    found = custody.newest(survey(spark, shelf)).first()
    if found is None:
        raise FileNotFoundError(f"no backup in {shelf}")
    return f"{shelf}/{found['backup']}"


def prune(spark: SparkSession, shelf: str, keep_ms: int, minimum: int, holds: dict[str, str] | None = None, now_ms: int | None = None, apply: bool = False) -> dict[str, str]:
    """The decision on each backup of a shelf, and with apply, the deletion of those marked "prune" and of nothing else."""
    if keep_ms < 1 or minimum < 1:
        raise ValueError("a policy keeps backups for some time, and one of them at least")
    files = Files(spark, shelf)
    if files.fs.exists(files._path(f"{shelf}/refs")):
        raise ValueError(f"{shelf} is a store, no shelf of backups")
    now = int(time.time() * 1000) if now_ms is None else now_ms
    # A row for each backup of one shelf.
    plan = {r["backup"]: r["decision"] for r in custody.retention(survey(spark, shelf, holds), minimum, now - keep_ms).collect()}
    for name, decision in sorted(plan.items()):
        if apply and decision == "prune":
            files.delete(f"{shelf}/{name}")
    return plan


def verify(spark: SparkSession, target: str, tenant: str, check, public_key: str) -> DataFrame:
    """Files that differ from the signed manifest; raises if the signature, tenant or format isn't good."""
    signed = signature(spark, target)
    head = signed["head"]
    if head["format_version"] > FORMAT or head["tenant"] != tenant or not check(public_key, json.dumps(head, sort_keys=True).encode(), signed["signature"]):
        raise Refused
    expected = spark.read.parquet(f"{target}/manifest")
    if _summary(expected) != {k: head[k] for k in ("files", "bytes", "lines")}:
        raise Refused
    return verify_manifest(expected, manifest(spark, f"{target}/data"))


def restore(spark: SparkSession, target: str, root: str, tenant: str, check, public_key: str) -> None:
    """Copies a verified backup to a place where nothing is."""
    there = Files(spark, root)
    if there.fs.exists(there._path(root)):
        raise FileExistsError(root)
    if not verify(spark, target, tenant, check, public_key).isEmpty():
        raise Refused
    files = Files(spark, target)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    jvm.org.apache.hadoop.fs.FileUtil.copy(files.fs, files._path(f"{target}/data"), there.fs, there._path(root), False, conf)


def receipt(kind: str, started_ms: int, ended_ms: int, checks: dict[str, bool]) -> dict:
    """A drill's receipt: passed only if every check did; its id is a digest of the rest."""
    body = {"kind": kind, "started_ms": started_ms, "ended_ms": ended_ms, "checks": dict(sorted(checks.items())), "passed": bool(checks) and all(checks.values())}
    return body | {"id": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}


def metrics_text(values: dict[str, float], prefix: str = "tidemark") -> str:
    return "".join(f"{prefix}_{name} {value:g}\n" for name, value in sorted(values.items()))


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.1f} {unit}" if unit != "B" else f"{int(n)} B"
        n /= 1024
    raise AssertionError


def human_duration(ms: int) -> str:
    s = ms / 1000
    return f"{ms} ms" if s < 1 else f"{s:.1f} s" if s < 60 else f"{int(s // 60)} min {int(s % 60)} s"
