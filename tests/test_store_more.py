import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_store import counters, env, store  # noqa: F401
from tidemark import cli
from tidemark.operators import merging, policy, vectors
from tidemark.operators.security import ActorRegistry, Refused, SoftwareSigner, attest, check_attestation, verifier
from tidemark.sources import formats


def test_stale_forget_and_integrity(spark, store, capsys):  # noqa: F811
    t = store.open_session("s1")
    hint = lambda k: spark.createDataFrame([(k, "text", None)], "key string, text string, embedding array<float>")
    row = spark.createDataFrame([("obs/S", "web:S", "x")], "k string, s string, p string")
    store.write(t, "s1", env(t, "s1"), formats.observations(row, F.col("k"), F.col("s"), F.col("p"), F.lit(3), F.lit(1)), hints=hint("obs/S"))
    claim = lambda key: formats.claims(spark.range(1), F.lit(key), predicate=F.lit("p"), subject=F.lit("s"), evidence=F.array(F.lit("web:S")), status=F.lit("Asserted"))
    store.read(t, "s1", "obs/S")
    store.write(t, "s1", env(t, "s1"), claim("claim/a"), hints=hint("claim/a"))
    store.write(t, "s1", env(t, "s1"), claim("claim/clean"), hints=hint("claim/clean"))
    assert store.mark_stale(t, "s1", "web:S", env(t, "s1")) is not None
    status = lambda: {r.key: r.claim.status for r in store.scan(t, "s1").where("claim is not null").collect()}
    assert status() == {"claim/a": "Stale", "claim/clean": "Asserted"}
    assert {r.key: r.stale for r in store.index("s1").collect()}["claim/a"] is False
    assert store.mark_stale(t, "s1", "web:S", env(t, "s1")) is None
    report = store.forget(t, "s1", "web:S", env(t, "s1"))
    assert (report["deindexed"], report["invalidated"]) == (2, 1)
    assert status() == {"claim/a": "Invalidated", "claim/clean": "Asserted"} and [r.key for r in store.index("s1").collect()] == ["claim/clean"]
    assert all(store.verify_integrity().values())
    bad = store.head("s1")
    spark.createDataFrame([("s1", 9, "new", "put")], "branch string, seq long, key string, op string").write.mode("append").parquet(f"{store.root}/records/commit_id={bad}")
    assert not store.verify_integrity()[bad]
    assert "s1" in cli.branches(spark, store.root)["branches"] and cli.manifest(spark, store.root)["files"] > 5


def test_custom_resolver(spark):
    columns = "side string, key string, kind string, counter long, members array<string>, body string, object string, valid_start long, valid_end long, method_rank int, confidence double"
    text = lambda side, key, body: (side, key, "text", None, None, body, None, None, None, None, None)
    rows = [text(s, k, f"{s}{k}") for s in ("base", "source", "target") for k in "abc"]
    plan = merging.decided(spark.createDataFrame(rows, columns))
    got = merging.resolve(plan, lambda df: pd.Series(["source" if k == "a" else "target" if k == "b" else "conflict" for k in df.key]))
    assert {r.key: (r.outcome, r.merged and r.merged.body) for r in got.collect()} == {"a": ("policy_source", "sourcea"), "b": ("policy_target", "targetb"), "c": ("conflict", None)}


def test_policy_documents():
    assert policy.validate(None) == [] and policy.validate({"version": "1", "rules": [{"effect": "Deny"}]}) == [(None, None, None, None, "Deny")]
    for bad in ({}, {"version": "x" * 129}, {"version": "1", "rules": [{"effect": "Maybe"}]}, {"version": "1", "rules": [{"effect": "Allow", "actor": ""}]}):
        with pytest.raises(ValueError):
            policy.validate(bad)


def test_fold_takes_the_buffer_in(spark):
    df = spark.createDataFrame([(f"v{i}", [float(i % 5) + 0.1, float(i % 3)]) for i in range(40)], "key string, embedding array<float>")
    c = vectors.centroids(df)
    folded = vectors.fold(vectors.assign(df, c), c, spark.createDataFrame([("v0", [9.0, 9.0]), ("new", [1.0, 0.0])], "key string, embedding array<float>"))
    assert folded.count() == 41 and [list(r.embedding) for r in folded.where("key = 'v0'").collect()] == [[9.0, 9.0]]


def test_attestation_can_t_be_rolled_back(spark):
    signer, check = SoftwareSigner(spark, "k"), verifier(spark)
    actors = ActorRegistry(check)
    actors.register("a", signer.public_key)
    made = attest(actors, "v1", 5, signer)
    check_attestation(made, actors, "v1", 5, check, signer.public_key)
    for args in ((actors, "v2", 5), (actors, "v1", 6), (ActorRegistry(check), "v1", 5)):
        with pytest.raises(Refused):
            check_attestation(made, *args, check, signer.public_key)


def test_flat_memory():
    assert cli.flat([100, 101, 99, 100, 102, 101]) and not cli.flat([100, 110, 130, 160, 200, 250]) and not cli.flat([1, 1])
