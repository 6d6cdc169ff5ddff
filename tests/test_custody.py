"""Keys, backups, drills and the operator's commands."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_store import counters, env, store  # noqa: F401
from tidemark import cli
from tidemark.operators import backup, custody, drill, policy
from tidemark.operators.security import ActorRegistry, KeyDirectory, Refused, SoftwareSigner, TrustRoot, attest, create_bundle, from_hex, verifier, verify_bundle_with
from tidemark.operators.store import Store

TWO = frozenset({"ann", "bo"})


def test_rotation_goes_forward_and_seals(spark):
    check, a, b = verifier(spark), SoftwareSigner(spark, "a"), SoftwareSigner(spark, "b")
    d = KeyDirectory(check)
    d.add(TrustRoot("a", "backup", a.public_key, 1, approvals=TWO, ceremony="c1"))
    d.activate("backup", "a")
    for bad in (TrustRoot("b", "backup", b.public_key, 1, approvals=TWO), TrustRoot("b", "backup", b.public_key, 2, approvals=frozenset({"ann", " "})), TrustRoot("a", "backup", b.public_key, 2, approvals=TWO)):
        with pytest.raises(ValueError):
            d.add(bad)
    d.add(TrustRoot("b", "backup", b.public_key, 2, approvals=TWO))
    with pytest.raises(Refused):
        d.resolve("backup", "b")
    d.activate("backup", "b")
    assert d.resolve("backup", "a").status == "retired" and d.verify("backup", b"x", a.sign(b"x"), "a").key_id == "a"
    again = KeyDirectory.from_json(d.to_json(), check)
    assert again.roots() == d.roots()
    for bad in ([*d.roots(), d.roots()[0]], [TrustRoot("x", "r", a.public_key, 1, status="active")], [TrustRoot(k, "r", a.public_key, n, status="active", approvals=TWO) for n, k in enumerate("xy")], [TrustRoot("x", "r", a.public_key, 1, status="revoked", approvals=TWO)], [TrustRoot(" ", "r", a.public_key, 1)]):
        with pytest.raises(ValueError):
            KeyDirectory(check, bad)
    with pytest.raises(ValueError):
        d.revoke("backup", "b", "lost")
    with pytest.raises(ValueError):
        d.revoke("backup", "a", " ")
    d.revoke("backup", "b", "lost", seal=True)
    with pytest.raises(Refused):
        d.signing_root("backup")
    with pytest.raises(ValueError):
        d.add(TrustRoot("c", "backup", a.public_key, 3, approvals=TWO))


def test_bundles_by_directory_and_hex(spark):
    a = SoftwareSigner(spark, "a")
    d = KeyDirectory(verifier(spark), [TrustRoot("a", "release", a.public_key, 1, "active", TWO)])
    bundle = create_bundle(b"rules", "p1", "policy", "1", 0, a)
    assert verify_bundle_with(d, "release", bundle, b"rules", "policy").key_id == "a"
    for args in (("release", bundle, b"other"), ("backup", bundle, b"rules"), ("release", {**bundle, "key_id": "z"}, b"rules")):
        with pytest.raises(Refused):
            verify_bundle_with(d, *args)
    assert from_hex(" 00fF\n", 2) == b"\x00\xff"
    for bad in ("00f", "00ff00", "0x0f", "zz00"):
        with pytest.raises(ValueError):
            from_hex(bad, 2)


def test_production_stores(spark, store, tmp_path):  # noqa: F811
    check, alice = verifier(spark), SoftwareSigner(spark, "alice")
    actors = ActorRegistry(check)
    for args in ((None,), (actors,)):
        with pytest.raises(Refused):
            Store.production(spark, str(tmp_path / "p"), store.issuer, *args)
    assert not (tmp_path / "p").exists()
    actors.register("agent", alice.public_key)
    with pytest.raises(Refused):
        Store.production(spark, str(tmp_path / "p"), store.issuer, actors, pin="other")
    made = attest(actors, "v1", 3, alice)
    with pytest.raises(Refused):
        Store.attested(spark, str(tmp_path / "p"), store.issuer, actors, made, "v1", 4, check, alice.public_key)
    p = Store.attested(spark, str(tmp_path / "p"), store.issuer, actors, made, "v1", 3, check, alice.public_key, clock=store.clock, pin=actors.fingerprint())
    t = p.open_session("s1")
    with pytest.raises(Refused):
        p.write(t, "s1", env(t, "s1"), counters(spark, a=1))
    p.write(t, "s1", env(t, "s1").signed(alice), counters(spark, a=1))


def test_verdicts_are_kept_with_version_and_request():
    doc = {"version": "7", "rules": [{"effect": "Allow", "purpose": "answer"}, {"effect": "Deny", "label": 3}]}
    asked = {"actor": "a", "label": 3, "purpose": "answer", "action": "x"}
    assert policy.verdict(doc, asked) == {"decision": "Deny", "rationale": "a rule denies", "version": "7", "request": asked}
    assert policy.verdict(doc, asked | {"label": 1})["decision"] == "Allow" and policy.verdict(None, asked)["decision"] == "Deny"


def test_shelf_and_drill(spark, store, tmp_path):  # noqa: F811
    t = store.open_session("s1")
    store.write(t, "s1", env(t, "s1"), counters(spark, a=1))
    signer, check = SoftwareSigner(spark, "k"), verifier(spark)
    directory = KeyDirectory(check, [TrustRoot("k", "backup", signer.public_key, 1, "active", TWO)])
    shelf = str(tmp_path / "shelf")
    with pytest.raises(FileNotFoundError):
        backup.newest(spark, shelf)
    for n in range(4):
        backup.create(spark, store.root, f"{shelf}/b{n}", "acme", signer, now_ms=n * 1000)
    (tmp_path / "shelf/notes").mkdir()
    assert backup.newest(spark, shelf) == f"{shelf}/b3" and backup.verify_with(spark, f"{shelf}/b3", "acme", directory).isEmpty()
    want = {"b0": "keep: held", "b1": "prune", "b2": "keep: recent", "b3": "keep: minimum copies"}
    assert backup.prune(spark, shelf, 1500, 1, {"b0": "a case"}, now_ms=3000) == want
    assert backup.survey(spark, shelf).count() == 4
    backup.prune(spark, shelf, 1500, 1, {"b0": "a case"}, now_ms=3000, apply=True)
    assert sorted(p.name for p in (tmp_path / "shelf").iterdir()) == ["b0", "b2", "b3", "notes"]
    for bad in ((shelf, 0, 1), (shelf, 1, 0), (store.root, 1, 1)):
        with pytest.raises(ValueError):
            backup.prune(spark, *bad)

    told: list = []
    reopen = lambda root: Store(spark, root, store.issuer, clock=store.clock)
    receipt = drill.run(spark, store.root, str(tmp_path / "drill"), "acme", signer, directory, reopen, notify=told.append)
    assert receipt["passed"] and len(receipt["checks"]) == 7 and told == [receipt]
    strange = KeyDirectory(check, [TrustRoot("k", "backup", SoftwareSigner(spark, "z").public_key, 1, "active", TWO)])
    failed = drill.run(spark, store.root, str(tmp_path / "drill2"), "acme", signer, strange, reopen)
    assert not failed["passed"] and not failed["checks"]["3 verified apart"] and failed["checks"]["2 backup"]
    for bad in (f"{store.root}/inside", str(tmp_path), str(tmp_path / "drill")):
        with pytest.raises(ValueError):
            drill.run(spark, store.root, bad, "acme", signer, directory, reopen)


def test_commands(spark, store, tmp_path, capsys):  # noqa: F811
    t = store.open_session("s1")
    store.write(t, "s1", env(t, "s1"), counters(spark, a=1))
    signer = SoftwareSigner(spark, "k1")
    (tmp_path / "key").write_text("\n".join(signer.export()))
    (tmp_path / "pub").write_text(signer.public_key)
    register, shelf = str(tmp_path / "roots.json"), str(tmp_path / "shelf")

    def run(*args, code=0):
        assert cli.main([str(a) for a in args]) == code
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    keys = lambda verb, *more, code=0: run("keys", verb, "--trust-roots", register, "--role", "backup", "--key-id", "k1", *more, code=code)
    keys("expand", "--public-key-file", tmp_path / "pub", "--generation", 1, "--ceremony", "c", "--approver", "ann", code=1)
    keys("expand", "--public-key-file", tmp_path / "pub", "--generation", 1, "--ceremony", "c", "--approver", "ann", "--approver", "bo")
    assert keys("activate")["roots"] == [{"key_id": "k1", "role": "backup", "generation": 1, "status": "active"}]
    assert keys("drill", "--signing-key-file", tmp_path / "key")["signs"] == "k1"
    assert run("inspect", "--path", store.root, "--tenant", "acme")["branches"] == 2
    assert run("verify", "--path", store.root, "--tenant", "acme")["damaged"] == []
    run("verify", "--path", tmp_path / "nothing", "--tenant", "acme", code=1)
    run("verify-backup", "--shelf", shelf, "--tenant", "acme", "--trust-roots", register, code=1)
    made = run("backup", "--path", store.root, "--tenant", "acme", "--shelf", shelf, "--signing-key-file", tmp_path / "key", "--key-id", "k1")
    assert run("verify-backup", "--shelf", shelf, "--tenant", "acme", "--trust-roots", register)["backup"] == made["backup"]
    run("verify-backup", "--path", made["backup"], "--tenant", "other", "--public-key-file", tmp_path / "pub", code=1)
    run("restore", "--shelf", shelf, "--tenant", "acme", "--out", tmp_path / "again", "--public-key-file", tmp_path / "pub")
    assert run("branches", tmp_path / "again")["branches"] == store.log.refs["branches"]
    assert list(run("backup-prune", "--shelf", shelf, "--keep-days", 1, "--minimum-copies", 1)["decisions"].values()) == ["keep: minimum copies"]
    run("--metrics-file", tmp_path / "metrics", "preflight", "--path", tmp_path, "--records", 1)
    assert "tidemark_passed 1" in (tmp_path / "metrics").read_text()
    run("--metrics-file", tmp_path / "metrics", "preflight", "--path", tmp_path, "--records", 10**12, code=1)
    assert "tidemark_passed 0" in (tmp_path / "metrics").read_text()
    keys("revoke", "--reason", "lost", code=1)
    assert keys("revoke", "--reason", "lost", "--seal-role")["sealed"] == ["backup"]
    keys("drill", "--signing-key-file", tmp_path / "key", code=1)


def test_percentiles(spark):
    df = spark.range(101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("ms"))
    r = custody.percentiles(df, "g", "ms").first()
    assert (r.n, r.p50, r.p95, r.p99) == (101, 50.0, 95.0, 99.0)


def test_descriptions(spark):
    from tidemark.functions import exprs as X

    none = F.lit(None)
    say = lambda c: spark.range(1).select(c.alias("v")).first().v
    value = lambda kind, **k: say(X.describe_value(F.lit(kind), *[k.get(x, none) for x in ("size", "counter", "members", "flag", "body", "number")]))
    assert value("blob", size=F.lit(5)) == "5 bytes of data" and value("flag", flag=F.lit(True)) == "true" and value("set", members=F.array(F.lit("a"))) == "set of 1"
    assert value("text", body=F.lit("x" * 61)) == '"' + "x" * 60 + '..." (61 characters)' and value("number", number=F.lit(1.5)) == "1.5"
    assert say(X.describe_key(F.lit(b"a/b"))) == "a/b" and say(X.describe_key(F.lit(b"\xff\xfe"))) == "<2 bytes>"
