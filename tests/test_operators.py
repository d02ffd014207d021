"""Rules of the evidence operators on a few rows each."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import identity, norm
from factloom.operators import contradict, evaluate, facts, graph, match, resolve, runs, search, temporal


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_normalisers(spark):
    c = F.col
    assert one(spark, norm.statement(c("a")), a="  The  Limit is 5 .") == "the limit is 5"
    assert [one(spark, norm.unit(c("a")), a=u) for u in ("$", "Minutes", "NONE", " furlong ")] == ["usd", "minute", None, "furlong"]
    assert [one(spark, norm.value_number(c("a")), a=v) for v in ("$1,150.00", "15%", "-2 usd", "SEK", "1 2")] == [1150.0, 15.0, -2.0, None, None]
    assert one(spark, norm.terms(c("a")), a="What does the process cost? 4.5% of passes...") == ["process", "cost", "4.5%", "passe"]
    assert one(spark, norm.numbers(c("a")), a="4.50, 4.5 and 10") == ["10", "4.5"]
    assert one(spark, norm.number_text(F.lit(12345678.0))) == "12345678" and one(spark, norm.number_text(F.lit(0.0))) == "0"
    for late, (a, b) in ((True, (2, 1)), (False, (1, 1)), (False, (None, 1)), (True, (1, None)), (False, (None, None))):
        assert one(spark, norm.later(F.lit(a).cast("int"), F.lit(b).cast("int"))) is late


def test_identity(spark):
    base = lambda s, v, u: one(spark, identity.base_fact_id(F.lit(s), F.lit("e"), F.lit("a"), F.lit(v), F.lit(u).cast("string")))
    assert base("one", "$150.00", "usd") == base("two", "150", "dollars") != base("two", "151", "dollars")
    text = lambda s: one(spark, identity.base_fact_id(F.lit(s), F.lit(None).cast("string"), F.lit("a"), F.lit("1"), F.lit("x")))
    assert text("A  b.") == text("a b") != text("a c")
    assert one(spark, identity.contradiction_id(F.lit("p"), F.lit("q"))) == one(spark, identity.contradiction_id(F.lit("q"), F.lit("p")))


FACT = "id string, entity string, attribute string, value string, unit string, tier string, valid_us bigint, invalid_us bigint, created_us bigint, expired_us bigint"


def test_contradictions_and_staleness(spark):
    rows = [
        ("a", "e", "x", "25", "day", "code", 10, 30, 11, None), ("b", "e", "x", "30", None, "documented", 20, None, 21, None), ("c", "e", "x", "30", "day", "code", 30, None, 31, None),
        ("d", "e", "x", "25", "usd", "code", 10, None, 11, None), ("f", "e", "x", "99", "day", "code", 10, None, 11, 12), ("g", None, "x", "1", None, "code", 10, None, 11, None),
        ("k", "e", "x", "half up", "day", "documented", None, 15, 11, None), ("l", "e", "x", None, None, "code", 10, None, 11, None), ("m", "e", "x", "30", None, "code", 25, 40, 50, None),
    ]
    df = spark.createDataFrame(rows, FACT)
    for slices in (32, 2):
        got = {(r.a, r.b): (r.winner, r.opened_us) for r in contradict.claim_contradictions(df, slices, 1).collect()}
        # a and c only touch; d has another unit than a and c; f is expired; b stands for m too
        assert got == {("a", "b"): ("b", 20), ("b", "d"): ("b", 20), ("a", "k"): ("a", 10)}
    assert {tuple(r) for r in contradict.claim_classes(df).collect()} >= {("m", "b"), ("b", "b"), ("c", "c")}
    stale = df.unionByName(spark.createDataFrame([("h", "e", "x", "25", None, "documented", 5, None, 6, None)], FACT))
    assert {tuple(r) for r in contradict.stale_claims(stale).collect()} == {("h", "c", 30), ("b", "d", 10)} - {("b", "d", 10)}
    assert contradict.claim_contradictions(df.where("false")).count() == 0


def test_a_hot_key_costs_its_values(spark):
    rows = [(f"f{n:05d}", "e", "x", str(n % 3), None, "code", n, n + 1, n, None) for n in range(3000)] + [("z", "e", "x", "9", None, "code", 0, 5000, 0, None)]
    got = {(r.a, r.b): r.opened_us for r in contradict.claim_contradictions(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {(f"f0000{n}", "z"): n for n in range(3)}


def test_merge_tiers(spark):
    row = lambda i, tier, key, conf=None: (i, "b", dt(2025, 1, int(i)), tier, dt(2025, 2, int(i)), conf, f"d/{i}", key, "clash")
    schema = "id string, base_id string, created_at timestamp_ntz, tier string, valid_at timestamp_ntz, confidence float, document_id string, source_key string, n string"
    tier = lambda *rows: facts.merge(spark.createDataFrame(list(rows), schema)).first()
    assert tier(row("1", "documented", None), row("2", "code", None), row("3", "documented", None)).tier == "code"
    assert tier(row("1", "executed", "test:a"), row("2", "code", "test:a")).tier == "code"
    assert tier(row("1", "executed", None), row("2", "code", None)).tier == "executed"
    m = tier(row("1", "executed", None), row("2", "code", "test:a", 0.5), row("3", "executed", None, float("nan")))
    assert (m.tier, m.n_documents, m.source_key, m.confidence, m.n) == ("executed", 3, "test:a", 0.5, 3)


def test_pages_and_winners(spark):
    with pytest.raises(ValueError):
        facts.page(spark.range(1), limit=0)
    rows = [("o", "n1", 5), ("o", "n2", 3), ("x", "x", 1)]
    got = [tuple(r) for r in facts.superseded(spark.createDataFrame(rows, "old string, new string, at bigint")).collect()]
    assert got == [("o", 3, "n2")]


def test_steps(spark):
    over = spark.createDataFrame([("p", 2, "v2"), ("p", 5, "v5")], "path string, step int, content string")
    assert [r.content for r in temporal.forward_asof(over, list(range(7)), "path", "step", "content").orderBy("step").collect()] == ["v2"] * 3 + ["v5"] * 3 + [None]
    states = spark.createDataFrame([("p", n, v) for n, v in enumerate(["a", "a", "b", "b", None, "b"])], "path string, step int, blob string")
    assert [r.changed_step for r in temporal.last_change(states, "path", "step", "blob").orderBy("step").collect()] == [0, 0, 2, 2, 4, 5]


def test_runs(spark):
    rows = [("t", 0, 1, "passed"), ("t", 2, 1, "failed"), ("t", 3, 1, "failed"), ("t", 3, 2, "passed"), ("t", 4, 1, "skipped"), ("t", 5, 1, "passed"), ("u", 1, 1, "error")]
    r = spark.createDataFrame(rows, "node string, step int, attempt int, outcome string")
    assert {(x.node, x.step) for x in runs.by_step(r).where("flaky").collect()} == {("t", 3)}
    assert {tuple(x) for x in runs.demotion(r).collect()} == {("t", 2, 2), ("t", 3, 2), ("t", 4, 2)}
    change = spark.createDataFrame([("t", 4)], "node string, step int")
    assert runs.lifted(r, change, 4).count() == 0 and [tuple(x) for x in runs.lifted(r, change, 6).collect()] == [("t", 5)]


def test_search_and_graph(spark):
    docs = spark.createDataFrame([("a", "late fee rules"), ("b", "the late fees"), ("c", None), ("d", "")], "id string, text string")
    asked = spark.createDataFrame([(1, "what is the late fee"), (2, "of the"), (3, None), (4, "rules")], "q int, text string")
    assert {(r.q, r.id, r.score) for r in search.text_search(docs, asked, "id", "text").collect()} == {(1, "a", 1.0), (1, "b", 0.5), (4, "a", 1.0)}
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [1.0])], "id int, e array<float>")
    ask = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("z", None)], "q string, embedding array<float>")
    for numbers in (8_000_000, 2):
        search.BLOCK_NUMBERS = numbers
        hit = search.vector_search(vec, ask, "id", "e", limit=2)
        assert {(r.q, r.id, r.score, r["rank"]) for r in hit.collect()} == {("x", 1, 1.0, 1), ("x", 3, 0.707107, 2), ("y", 3, 0.707107, 1), ("y", 1, 0.0, 2)}
    search.BLOCK_NUMBERS = 8_000_000
    members = spark.createDataFrame([("f", e, k, p) for e, k, p in (("a", "rule", 1), ("b", None, 2), ("c", "flag", 3), ("h", "team", 0), ("a", "rule", 9))] + [("g", f"n{n}", "rule", n) for n in range(9)] + [(None, "q", "rule", 1)], "fact_id string, entity string, kind string, position int")
    got = {tuple(r) for r in graph.relations(members, most=5).collect()}
    assert got == {("a", "h", "part_of"), ("b", "h", "part_of"), ("c", "h", "part_of"), ("a", "b", "related"), ("a", "c", "related"), ("b", "c", "related")} | {(f"n{n}", "g", "named_by") for n in range(9)}
    edges = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("a", "c"), ("c", "d"), ("d", "d"), (None, "a")], "src string, dst string")
    start, hubs = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("hub",)], "id string")
    assert {tuple(r) for r in graph.reach(edges, start, 2).collect()} == {("a", 0), ("hub", 1), ("c", 1), ("b", 2), ("d", 2)}
    assert {tuple(r) for r in graph.reach(edges, start, 2, hubs).collect()} == {("a", 0), ("c", 1), ("d", 2)}
    assert {r.id for r in graph.reach(edges, hubs, 1, hubs).collect()} == {"hub", "a", "b"}


def test_resolve(spark):
    ents = spark.createDataFrame([("E1", "late-fee", "rule", ["lf"]), ("E2", "late_fee", "flag", None)], "id string, name string, kind string, aliases array<string>")
    names = spark.createDataFrame([("Late-Fee", None), ("LF", None), ("late fee", "flag"), ("late fee", None), ("nothing", None), (" ", None), (None, None)], "name string, kind string")
    got = {(r.name, r.kind): (r.entity_id, r.how) for r in resolve.resolve(names, ents).collect()}
    assert got == {("Late-Fee", None): ("E1", "name"), ("LF", None): ("E1", "alias"), ("late fee", "flag"): ("E2", "folded"), ("late fee", None): ("E1", "folded"), ("nothing", None): (None, "new")}


def test_matching(spark):
    m = lambda a, b: one(spark, match.statements_match(F.lit(a), F.lit(b)))
    assert m("The refund is accepted within 14 days", "refund accepted within 14 days")
    assert not m("The refund is accepted within 14 days", "refund accepted after 14 days")
    assert not m("The refund is accepted within 14 days", "the refund is never accepted within 14 days")
    assert not m("The fee is 5 per day", "The fee is 6 per day")
    assert one(spark, match.bounds(F.lit("Within 14 days, or more than 14.50 days later; the past 7 days count. At most 2 hours"))) == ["beyond 14.5 day", "inside 14 day", "inside 2 hour"]
    assert not m("refund accepted within 14 days or after 3 hours", "refund accepted within 3 hours or within 14 days") and one(spark, match.bounds(F.lit("nothing"))) == []


def test_assignment_takes_turns(spark):
    import random

    rng = random.Random(5)
    returned = [(g, f"r{n:03d}", f"a{rng.randrange(6)}", rng.randrange(9)) for g in "xy" for n in range(70)]
    expected = [(g, f"e{n:03d}", f"b{rng.randrange(7)}") for g in "xy" for n in range(50)]
    pairs = {(g, f"a{i}", f"b{j}"): rng.choice([0.3, 0.5, 0.8]) for g in "xy" for i in range(6) for j in range(7) if rng.random() < 0.5}
    want, free = set(), {}
    for g, e, b in sorted(expected):
        free.setdefault((g, b), []).append(e)
    turns = []
    for g, r, a, o in sorted(returned, key=lambda x: (x[0], x[3], x[1])):
        best = sorted((-s, b) for (h, c, b), s in pairs.items() if h == g and c == a and free.get((g, b)))
        if best:
            turns.append((g, r, best[0][1]))
            free[g, best[0][1]].pop(0)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = match.assign(frame(returned, "grp string, returned string, side string, ordinal int"), frame(expected, "grp string, expected string, side string"),
                       frame([(*k, v) for k, v in pairs.items()], "grp string, a string, b string, score double")).collect()
    side = {(g, e): b for g, e, b in expected}
    assert {(r.grp, r.returned, side[r.grp, r.expected]) for r in got} == set(turns) and len({(r.grp, r.expected) for r in got}) == len(got) == len(turns) > 60


def test_measures(spark):
    rows = spark.createDataFrame([("s", True, True), ("s", True, False), ("t", False, False)], "k string, expected boolean, returned boolean")
    got = {r.k: (r.precision, r.recall, r.f1) for r in evaluate.precision_recall(rows, ["k"]).collect()}
    assert got == {"s": (1.0, 0.5, 0.666667), "t": (None, None, None)}
    assert one(spark, evaluate.wilson_lower(F.lit(8), F.lit(10))) == pytest.approx(0.49, abs=0.01)


def test_a_repeated_value_does_not_keep_facts_open(spark):
    from factloom.operators import facts

    rows = [("a", 5, 1), ("b", 5, 2), ("c", 7, 3), ("d", 5, 3), ("e", 5, 4), ("f", 6, 5), ("g", 6, 5)]
    df = spark.createDataFrame([(i, "x", "y", str(n), v) for i, n, v in rows], "id string, entity string, attribute string, value string, valid_us long")
    got = {tuple(r) for r in facts.closed_by_conflict(df, ["entity", "attribute"]).collect()}
    assert got == {("a", "c", 3), ("b", "c", 3), ("c", "e", 4), ("d", "f", 5), ("e", "f", 5)}
