import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import actions, graph, merging, policy, recall, retrieval, vectors
from tidemark.operators.versions import prefix_upper
from tidemark.sources import adapters as A


def value(spark, column, **row):
    names = {k: v for k, v in row.items()}
    schema = ", ".join(f"{k} {t}" for k, (_, t) in names.items()) or "x int"
    return spark.createDataFrame([tuple(v for v, _ in names.values()) or (1,)], schema).select(column.alias("v")).first().v


def test_intervals(spark):
    def contains(start, end, at):
        return value(spark, X.contains(F.col("s"), F.col("e"), F.lit(at)), s=(start, "long"), e=(end, "long"))

    assert [contains(100, 200, t) for t in (99, 100, 199, 200)] == [False, True, True, False]
    assert contains(None, None, 5) and contains(None, 6, 5) and not contains(None, 5, 5)
    meet = lambda *x: value(spark, X.overlaps(*[F.col(c) for c in "abcd"]), **{k: (v, "long") for k, v in zip("abcd", x)})
    assert not meet(0, 100, 100, 200) and meet(0, 100, 50, 150) and meet(None, None, 1, 2)


def test_counters_saturate(spark):
    def merge(b, s, t):
        return value(spark, X.merge_counters(F.col("b"), F.col("s"), F.col("t")), b=(b, "long"), s=(s, "long"), t=(t, "long"))

    assert merge(10, 13, 15) == 18 and merge(None, 3, 5) == 8
    assert merge(0, X.MAX_LONG, 5) == X.MAX_LONG and merge(0, X.MIN_LONG, -5) == X.MIN_LONG


def test_vectors_and_terms(spark):
    cos = lambda a, b: value(spark, X.cosine(F.col("a"), F.col("b")), a=(a, "array<float>"), b=(b, "array<float>"))
    assert cos([1.0, 0.0], [0.0, 2.0]) == 0 and cos([1.0, 1.0], [2.0, 2.0]) == pytest.approx(1)
    assert cos([0.0], [1.0]) is None and cos([], []) is None and cos([1.0], [1.0, 2.0]) is None
    assert value(spark, X.terms(F.lit("The CAT, sat-on 2 été!"))) == ["the", "cat", "sat", "on", "2", "été"] == retrieval.tokenize("The CAT, sat-on 2 été!")
    assert value(spark, X.token_cost(F.lit("12345"))) == 3


def test_prefix_upper():
    assert prefix_upper(b"ab") == b"ac" and prefix_upper(b"a\xff") == b"b" and prefix_upper(b"\xff\xff") is None


def test_merge_decisions(spark):
    claim = lambda side, method, conf, start, end, obj="a": (side, "k", "claim", None, None, None, obj, start, end, method, conf)
    columns = "side string, key string, kind string, counter long, members array<string>, body string, object string, valid_start long, valid_end long, method_rank int, confidence double"

    def outcome(*rows):
        r = merging.decided(spark.createDataFrame(list(rows), columns)).first()
        return r.outcome, r.merged

    assert outcome(claim("source", 0, 0.95, 0, None, "x"), claim("target", 5, 0.60, 0, None, "y"))[0] == "claim_target"
    assert outcome(claim("source", 3, 0.9, 0, 100), claim("target", 3, 0.9, 100, None))[0] == "claim_target"
    assert outcome(claim("source", 3, 0.9, 0, None, "x"), claim("target", 3, 0.9, 0, None, "y"))[0] == "conflict"
    counter = lambda side, n: (side, "k", "counter", n, None, None, None, None, None, None, None)
    assert outcome(counter("base", 1), counter("target", 5))[0] == "conflict"
    assert outcome(counter("base", 1), counter("target", 1))[0] == "none"
    assert outcome(counter("base", 1), counter("source", 7), counter("target", 7))[0] == "none"
    kept = outcome(counter("base", 10), counter("source", 13), counter("target", 15))
    assert kept[0] == "counter" and kept[1].counter == 18


def test_policy_against_truth_table(spark):
    rng = np.random.default_rng(4)
    actors, purposes, acts = ["a", "b", None], ["p", "q", None], ["x", "y", "z", None]
    rules = [(actors[rng.integers(3)], [0, 1, 2, 3, None][rng.integers(5)], purposes[rng.integers(3)], acts[rng.integers(4)], ["Allow", "Deny"][rng.integers(2)]) for _ in range(9)]
    asked = list(itertools.product("ab", range(4), "pq", "xyz"))
    df = policy.decide(spark.createDataFrame(asked, "actor string, label int, purpose string, action string"), spark.createDataFrame(rules, "r_actor string, r_label int, r_purpose string, r_action string, effect string"))
    got = {(r.actor, r.label, r.purpose, r.action): r.decision for r in df.collect()}
    for q in asked:
        effects = {e for *m, e in rules if all(x is None or x == y for x, y in zip(m, q))}
        assert got[q] == ("Allow" if effects == {"Allow"} else "Deny")
    none = policy.decide(spark.createDataFrame(asked[:2], "actor string, label int, purpose string, action string"), A.rules(spark).limit(0))
    assert {r.decision for r in none.collect()} == {"Deny"}


def test_packing_is_greedy_over_whole_items(spark):
    rng = np.random.default_rng(8)
    rows = [(f"k{i:03d}", float(rng.integers(0, 5)), int(rng.integers(1, 30)), bool(i % 7 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "key string, score double, cost long, stale boolean")
    for budget in (0, 40, 400, 10**6):
        packed = retrieval.pack(df, budget)
        got = [r.key for r in packed.where("packed").orderBy("pack_rank").collect()]
        used, want = 0, []
        for key, _, cost, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
            if used + cost <= budget:
                used, want = used + cost, [*want, key]
        assert got == want
        total = retrieval.totals(packed).first()
        assert (total.considered, total.n_packed, total.used, total.dropped) == (150, len(want), used, 150 - len(want))


def test_flood_depth_and_cycles(spark):
    chain = [("main", f"n{i}", f"n{i + 1}") for i in range(66)]
    seeds = lambda n: spark.createDataFrame([("main", n)], "branch string, node_id string")
    edges = spark.createDataFrame([*chain, ("main", "n66", "n60"), ("other", "n0", "zz")], "branch string, parent string, node_id string")
    with pytest.raises(graph.DepthExceeded):
        graph.flood(edges, seeds("n0"), max_depth=8)
    found = {r.node_id: r.depth for r in graph.flood(edges, seeds("n58")).collect()}
    assert found == {f"n{i}": i - 58 for i in range(58, 67)}


def test_criss_cross_has_two_bases(spark):
    commits = spark.createDataFrame([("a", "r"), ("b", "r"), ("x", "a"), ("x", "b"), ("y", "b"), ("y", "a"), ("z", "a")], "commit string, parent string")
    pairs = spark.createDataFrame([("x", "y"), ("x", "z"), ("a", "b")], "a string, b string")
    got = {(r.a, r.b, r.base) for r in graph.merge_bases(commits, pairs).collect()}
    assert got == {("x", "y", "a"), ("x", "y", "b"), ("x", "z", "a"), ("a", "b", "r")}


def test_recall_puts_the_irreversible_first(spark):
    nodes = spark.createDataFrame([("main", "n1", "obs/S", "web", [], ["web:S"]), ("main", "n2", "claim/risk", "agent", ["n1"], [])], "branch string, node_id string, key string, actor string, parents array<string>, sources array<string>")
    done = spark.createDataFrame([("claim/risk", "identity.suspend_account", "user-42", "act-1", "identity.reinstate_account")], "evidence_key string, action_type string, target string, action_id string, compensating_action string")
    plan = recall.plan(nodes, done, "web:S")
    assert [r.section for r in recall.ordered(plan).collect()] == ["irreversible", "reversible", "reversible"]
    text = recall.render(plan)
    assert text.index("suspend_account on user-42") < text.index("obs/S") and text.startswith("DRY RUN")


def test_gateway():
    class Suspend:
        action_type, is_simulated, compensating_action = "suspend", False, "reinstate"
        calls = 0

        def execute(self, p):
            self.calls += 1
            return actions.Outcome("success", None if p.target == "lost" else "HELPDESK-1")

    c = Suspend()
    g = actions.ActionGateway(lambda p: p.label < 3, [c])
    ask = lambda key, **k: actions.Proposal("suspend", k.pop("target", "u"), key, "agent", evidence=k.pop("evidence", ((True, "Asserted"),)), **k)
    assert g.execute(ask("1"))["status"] == "Succeeded" and g.execute(ask("1"))["receipt"] == "HELPDESK-1" and c.calls == 1
    assert g.execute(ask("2", target="lost"))["status"] == "Indeterminate"
    assert g.execute(ask("3", evidence=()))["status"] == "Refused: no evidence"
    assert g.execute(ask("3"))["status"] == "Refused: no evidence"  # the first decision stays
    assert g.execute(ask("4", evidence=((True, "Stale"),)))["status"] == "Refused: no evidence"
    assert g.execute(ask("5", label=3))["status"] == "Refused: policy"
    assert g.execute(ask("6", simulation=True))["status"] == "Refused: simulation"
    g.switch.disable_tenant("t")
    g.switch.disable_all()
    g.switch.enable_all()
    assert g.execute(ask("7", tenant="t"))["status"] == "Refused: disabled"
    assert not hasattr(actions.AgentStore(), "execute")


def test_vector_index(spark):
    rng = np.random.default_rng(9)
    hubs = rng.normal(size=(12, 32))
    v = (hubs[rng.integers(0, 12, 600)] + rng.uniform(-0.25, 0.25, (600, 32))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", [float(x) for x in row]) for i, row in enumerate(v)] + [("none", None), ("zero", [0.0] * 32)], "key string, embedding array<float>").cache()
    c = vectors.centroids(df)
    cells = vectors.assign(df, c).cache()
    hits = 0
    for q in v[:5]:
        query = [float(x) for x in q]
        want = {r.key for r in vectors.exact(df, query, 10).collect()}
        hits += len(want & {r.key for r in vectors.search(cells, c, None, query, 10).collect()})
    assert hits / 50 >= 0.9
    new = spark.createDataFrame([("v0000", [-x for x in map(float, v[0])]), ("fresh", [float(x) for x in v[0]])], "key string, embedding array<float>")
    top = [r.key for r in vectors.search(cells, c, new, [float(x) for x in v[0]], 3).collect()]
    assert top[0] == "fresh" and "v0000" not in top
    with pytest.raises(ValueError):
        vectors.search(cells, c, None, [1.0], 3)
    batch = vectors.exact_batch(df, spark.createDataFrame([("q", [float(x) for x in v[3]])], "query string, vector array<double>"), 4)
    assert [r.key for r in batch.orderBy("rank").collect()] == [r.key for r in vectors.exact(df, [float(x) for x in v[3]], 4).orderBy("rank").collect()]


def test_open_ended_claims_contradict_too(spark, monkeypatch):
    from tidemark.plans import belief

    rows = [(1, "x", 0, None), (2, "y", 10, 20), (3, "x", 15, None), (4, "y", 30, 40), (5, "z", None, 5), (6, None, 0, None)]
    claims = spark.createDataFrame([("s", "p", e, o, a, b) for e, o, a, b in rows], "subject string, predicate string, event_id long, object string, valid_start long, valid_end long")
    monkeypatch.setattr(belief.A, "claims", lambda spark, sf_dir: claims)
    got = {r.event_id: (r.n_contradictions, r.next_contradiction) for r in belief.open_overlap_contradictions(spark, "").collect()}
    assert got == {1: (3, 2), 2: (2, 3), 3: (2, 4), 4: (2, -1), 5: (1, 1)}


def test_search_as_registered_finds_nine_of_ten(spark):
    from tidemark.plans import recollection

    for sf in ("sf0.001", "sf0.1"):
        assert recollection.ann_recall(spark, f"/root/testdata/{sf}").first().recall >= 0.9


def test_exact_batch_goes_by_blocks(spark):
    e = spark.createDataFrame([(f"k{i}", [float(i % 7 - 3), float(i % 5 + 1), 1.0]) for i in range(40)], "key string, embedding array<float>")
    q = e.selectExpr("key query", "embedding vector")
    rows = lambda df: sorted((r.query, r.key, r.similarity, r["rank"]) for r in df.collect())
    assert rows(vectors.exact_batch(e, q, 3, max_queries=7)) == rows(vectors.exact_batch(e, q, 3))
    c = vectors.centroids(e)
    cells = vectors.assign(e, c)
    one = [(r.key, r.similarity) for r in vectors.search(cells, c, None, [1.0, 2.0, 1.0], 3, probes=2).collect()]
    many = vectors.search_batch(cells, c, None, spark.createDataFrame([("q", [1.0, 2.0, 1.0])], "query string, vector array<float>"), 3, probes=2).collect()
    assert [(r.key, r.similarity) for r in sorted(many, key=lambda r: r["rank"])] == one


def test_a_walk_that_is_cut_says_so(spark):
    nodes = spark.createDataFrame([("main", f"n{i}", [f"n{i - 1}"] if i else [], ["web:S"] if not i else []) for i in range(8)], "branch string, node_id string, parents array<string>, sources array<string>")
    found = nodes.select("branch", "node_id")
    whole = {r.node_id: r.via for r in graph.derived_via(nodes, found, "web:S").collect()}
    assert whole["n7"] == [f"n{i}" for i in range(7, -1, -1)]
    short = {r.node_id: r.via for r in graph.derived_via(nodes, found, "web:S", max_depth=4).collect()}
    assert short["n7"][-1] == graph.CUT and short["n2"] == ["n2", "n1", "n0"] and len(short) == 8


def test_reachable_over_lines_and_nested_merges(spark):
    rng = np.random.default_rng(3)
    edges = [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 120)]
    edges += [(f"c{int(a):03d}", f"c{int(b):03d}") for a, b in rng.integers(0, 120, (25, 2)) if a > b]
    edges += [(f"s{k}.{i}", f"s{k}.{i - 1}") for k in range(4) for i in range(1, 9)] + [("c100", "s0.8"), ("s0.4", "s1.8"), ("s1.2", "s2.5")]
    commits = spark.createDataFrame(edges, "commit string, parent string")
    for heads in (["c119"], ["c050", "s3.3"], []):
        want, todo = set(), list(heads)
        while todo:
            c = todo.pop()
            if c not in want:
                want.add(c)
                todo += [b for a, b in edges if a == c]
        got = [r.commit for r in graph.reachable(commits, spark.createDataFrame([(h,) for h in heads], "commit string")).collect()]
        assert sorted(got) == sorted(want)


def test_merge_bases_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(f"n{a}", f"n{b}") for a in range(1, 30) for b in rng.integers(0, a, 2)})
    up = {f"n{a}": {f"n{a}"} for a in range(30)}
    for a in range(30):
        for x, y in edges:
            if x == f"n{a}":
                up[x] |= up[y]
    pairs = [("n29", "n28"), ("n20", "n25"), ("n7", "n29"), ("n11", "n12")]
    want = {(a, b, c) for a, b in pairs for c in up[a] & up[b] if not any(c in up[d] and c != d for d in up[a] & up[b])}
    got = graph.merge_bases(spark.createDataFrame(edges, "commit string, parent string"), spark.createDataFrame(pairs, "a string, b string"))
    assert {(r.a, r.b, r.base) for r in got.collect()} == want


def test_every_connector_counts(spark):
    asked = spark.createDataFrame([(k, k, f"k{k}", f"t.{k}", "u", "c/u", 0, False, 0, True, "t1", None) for k in (0, 10_500)], "event_id long, arrived long, idempotency_key string, action_type string, target string, evidence_key string, label int, simulation boolean, outcome int, has_evidence boolean, tenant string, compensating_action string")
    connectors = spark.range(11_000).select(F.concat(F.lit("t."), F.col("id")).alias("action_type"), F.lit(False).alias("simulated"))
    rules = spark.createDataFrame([(None, None, None, None, "Allow")], "r_actor string, r_label int, r_purpose string, r_action string, effect string")
    assert {r.status for r in actions.decide(asked, rules, [], connectors).collect()} == {"Succeeded"}


def test_queries_without_a_usable_vector_are_refused(spark):
    e = spark.createDataFrame([("a", [1.0, 0.0])], "key string, embedding array<float>")
    for bad in ([("p", [1.0, 0.0]), ("q", [1.0, 0.0, 0.0])], [("p", [1.0, 0.0]), ("q", None)], [("p", [])]):
        with pytest.raises(ValueError):
            vectors.exact_batch(e, spark.createDataFrame(bad, "query string, vector array<float>"), 3)


def test_a_report_tells_how_much_it_shows(spark):
    nodes = spark.createDataFrame([("main", f"n{i}", f"k{i}", "web", [], ["web:S"]) for i in range(7)], "branch string, node_id string, key string, actor string, parents array<string>, sources array<string>")
    done = spark.createDataFrame([("k0", "a.b", "u", "act-1", None)], "evidence_key string, action_type string, target string, action_id string, compensating_action string")
    plan = recall.plan(nodes, done, "web:S")
    assert recall.totals(plan) == {"irreversible": 1, "reversible": 7} and "REVERSIBLE (3 of 7 shown)" in recall.render(plan, limit=3)


def test_plan_order(spark):
    nodes = spark.createDataFrame([(b, f"n{i}", f"k{i}", "web", [], ["web:S"]) for b in ("main", "h1") for i in (2, 1)], "branch string, node_id string, key string, actor string, parents array<string>, sources array<string>")
    done = spark.createDataFrame([("k1", t, u, a, None) for t, u, a in (("z", "u", "1"), ("a", "v", "3"), ("a", "u", "2"), ("a", "u", "1"))], "evidence_key string, action_type string, target string, action_id string, compensating_action string")
    rows = recall.ordered(recall.plan(nodes, done, "web:S")).collect()
    assert [(r.action_type, r.target, r.action_id) for r in rows[:4]] == [("a", "u", "1"), ("a", "u", "2"), ("a", "v", "3"), ("z", "u", "1")]
    assert [(r.branch, r.key) for r in rows[4:]] == [("h1", "k1"), ("h1", "k2"), ("main", "k1"), ("main", "k2")]


def test_floods_with_small_and_large_frontiers(spark):
    """The same answer whether frontiers are broadcast or the edges dealt out into buckets."""
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame(sorted({(b, f"n{x}", f"n{y}") for b in ("main", "h1") for x, y in rng.integers(0, 200, (400, 2)) if x < y}), "branch string, parent string, node_id string")
    seeds = spark.createDataFrame([("main", "n0"), ("h1", "n1"), ("main", "n5")], "branch string, node_id string")
    rows = lambda: sorted((r.branch, r.node_id, r.depth, tuple(r.path)) for r in graph.flood(edges, seeds, with_path=True).collect())
    small = rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows() == small and len(small) > 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("dealt_")]
