import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webloom.operators.pagerank import pagerank, resume_pagerank
from webloom.operators.vertexprogram import (
    UnknownDestination,
    metric_delta,
    run_vertex_program,
    unknown_destinations,
)


def graph(spark, ids, pairs):
    return (
        spark.createDataFrame([(i,) for i in ids], "id string"),
        spark.createDataFrame([tuple(p) for p in pairs.split()], "src string, dst string"),
    )


def scores(result):
    return {r.id: round(r.score, 6) for r in result.vertices.collect()}


GOLDENS = [
    ("ABC", "AB AC BC CA", 14, {"A": 0.387911, "B": 0.214862, "C": 0.397227}),
    ("ABCD", "AB BC CA CD", 15, {"A": 0.213671, "B": 0.264537, "C": 0.308121, "D": 0.213671}),
    ("AB", "AA AB BB", 10, {"A": 0.350810, "B": 0.649190}),
    ("A", "", 2, {"A": 1.0}),
    ("AB", "", 2, {"A": 0.5, "B": 0.5}),
    ("ABC", "AB AB AC BA CA", 42, {"A": 0.486682, "B": 0.325545, "C": 0.187773}),
    ("ABCDE", "AB BC CD DE", 14, {"A": 0.081205, "B": 0.150169, "C": 0.208673, "D": 0.258705, "E": 0.301249}),
]


@pytest.mark.parametrize("ids, pairs, last, want", GOLDENS)
def test_pagerank_goldens(spark, ids, pairs, last, want):
    result = pagerank(*graph(spark, ids, pairs))
    assert result.superstep == last and scores(result) == want
    assert abs(sum(r.score for r in result.vertices.collect()) - 1) < 1e-9


def test_pagerank_with_blocked_hubs_is_the_same(spark):
    ids, pairs, last, want = GOLDENS[0]
    result = pagerank(*graph(spark, ids, pairs), edges_per_block=1)
    assert result.superstep == last and scores(result) == want


def test_pagerank_edges_of_unknown_vertices(spark):
    v, e = graph(spark, "ABC", "AB AC BC CA XA XY")
    assert scores(pagerank(v, e)) == GOLDENS[0][3]  # an unknown source is ignored
    v, e = graph(spark, "ABC", "AB AC BC CA AX XY")
    with pytest.raises(UnknownDestination):
        pagerank(v, e)
    assert [(r.src, r.dst) for r in unknown_destinations(v, e).collect()] == [("A", "X")]
    assert scores(pagerank(v, e, on_unknown_dst="drop")) == GOLDENS[0][3]


def test_pagerank_arguments(spark):
    v, e = graph(spark, "AB", "AB")
    for bad in ({"damping": -0.1}, {"damping": 1.1}, {"tolerance": 1.0}, {"tolerance": -1}):
        with pytest.raises(ValueError):
            pagerank(v, e, **bad)
    with pytest.raises(ValueError):
        pagerank(v, e, on_unknown_dst="ignore")
    assert scores(pagerank(v, e, damping=0, tolerance=0)) == scores(pagerank(v, e))
    # Damping 1 on a two-cycle stays put at once.
    assert pagerank(*graph(spark, "AB", "AB BA"), damping=1).superstep == 2


def test_pagerank_empty_and_limited(spark):
    empty = pagerank(*graph(spark, "AB", "AB"), max_steps=1)
    assert empty.superstep == 0
    v, e = graph(spark, "AB", "AB")
    none = pagerank(v.where("false"), e.where("false"))
    assert none.vertices.count() == 0
    three = pagerank(v, e, max_steps=3)
    assert [h["superstep"] for h in three.history] == [0, 1, 2]
    assert three.history[1]["sad"] == pytest.approx(1.0)


def test_history_delta(spark):
    history = pagerank(*graph(spark, "ABC", "AB AC BC CA"), max_steps=4).history_frame()
    rows = metric_delta(history.where("name = 'active'")).orderBy("superstep").collect()
    assert [(r.value, r.delta) for r in rows] == [(3, 3), (3, 0), (3, 0), (3, 0)]


def greatest_value(spark, vertices, edges, **options):
    grown = F.coalesce(F.col("msg") > F.col("value"), F.lit(False))
    return run_vertex_program(
        vertices,
        edges,
        update=lambda step, g: {} if step == 0 else {"value": F.greatest("value", "msg"), "grew": grown},
        message=F.when(F.col("grew"), F.col("value")),
        combine=F.max,
        halt=lambda step, g: F.lit(True),
        aggregates=lambda step: {"total": F.sum("value")},
        running={"total"},
        **options,
    )


def test_sleeping_vertices_wake_on_messages_and_the_run_ends(spark):
    v = spark.createDataFrame([("A", 1.0, True), ("B", 5.0, True), ("C", 2.0, True)], "id string, value double, grew boolean")
    _, e = graph(spark, "", "AB BC CA")
    seen = []
    result = greatest_value(spark, v, e, post_step=lambda step, g: seen.append((step, g["active"], g["total"])))
    assert {r.id: r.value for r in result.vertices.collect()} == {"A": 5, "B": 5, "C": 5}
    assert [a for _, a, _ in seen] == [3, 3, 2, 1, 0] or seen[-1][1] == 0
    totals = [t for *_, t in seen]
    assert totals == sorted(totals) and totals[0] == 8
    fixed = greatest_value(spark, v, e, max_steps=2)
    assert fixed.superstep == 1


def test_last_value_and_integer_ids(spark):
    v = spark.createDataFrame([(1, 1.0, True), (1, 3.0, True), (2, 0.0, True)], "id bigint, value double, grew boolean")
    e = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    result = greatest_value(spark, v, e)
    assert {r.id: r.value for r in result.vertices.collect()} == {1: 3, 2: 3}


def test_messages_to_a_given_vertex_and_stop_rule(spark):
    v = spark.createDataFrame([("A", 1.0), ("B", 0.0)], "id string, value double")
    _, e = graph(spark, "", "AA")
    options = dict(
        update=lambda step, g: {"value": F.coalesce("msg", "value")},
        message=F.lit(None).cast("double"),
        keep_running=lambda step, g: step < 1,
    )

    def to(name):
        return lambda step, senders: senders.where("id = 'A'").select(F.lit(name).alias("dst"), (F.col("value") + 1).alias("msg"))

    result = run_vertex_program(v, e, send=to("B"), **options)
    assert {r.id: r.value for r in result.vertices.collect()} == {"A": 1, "B": 2}
    with pytest.raises(UnknownDestination):
        run_vertex_program(v, e, send=to("X"), **options)
    dropped = run_vertex_program(v, e, send=to("X"), on_unknown_dst="drop", **options)
    assert {r.id: r.value for r in dropped.vertices.collect()} == {"A": 1, "B": 0}


def test_settings_are_restored_after_an_error(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    v, e = graph(spark, "AB", "AB")
    with pytest.raises(RuntimeError):
        pagerank(v, e, post_step=lambda step, g: (_ for _ in ()).throw(RuntimeError()))
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"))


@pytest.mark.parametrize("edges_per_block", [1_000_000, 1])
def test_edges_are_not_shuffled_in_a_superstep(spark, edges_per_block):
    from webloom.operators import vertexprogram as VP

    v, e = graph(spark, "ABCD", "AB BC CA CD")
    layout = VP._Layout(spark, v.withColumn("x", F.lit(1.0)), e, "error", 4, edges_per_block)
    assert layout.blocked == (edges_per_block == 1)
    from webloom.session import planning

    with planning(spark, {**layout.settings(), "spark.sql.autoBroadcastJoinThreshold": -1}):
        state = layout.vertices.withColumns({"_active": F.lit(True), "_ran": F.lit(True)})
        sent = layout.messages(state, F.col("x")).groupBy("_dst").agg(F.sum("msg").alias("msg"))
        joined = state.join(sent, F.col("_key") == F.col("_dst"), "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    layout.release()
    # One of them is the sum of the messages, the other brings the senders to
    # the edges, which are placed by the same hash and need none.
    assert plan.count("Exchange hashpartitioning") == 1


def test_checkpoints_of_old_supersteps_are_deleted(spark):
    import os

    from webloom.session import shared_dir

    root = shared_dir(spark).removeprefix("file:")

    def held():
        return sum(len(dirs) for path, dirs, _ in os.walk(root) if os.path.dirname(path) == root)

    v, e = graph(spark, "ABCD", "AB BC CA CD")
    before = held()
    result = pagerank(v, e)
    assert result.superstep > 10 and held() - before <= 6
    assert result.vertices.count() == 4


def edge_program(vertices, edges, steps, **options):
    """A vertex adds what it gets; an edge loses half of its weight and takes on its source's value."""
    return run_vertex_program(
        vertices,
        edges,
        update=lambda step, g: {"value": F.col("value") + F.coalesce("msg", F.lit(0))} if step else {},
        edge_update=lambda step, g: {"weight": F.floor(F.col("weight") / 2) + F.col("value") + step},
        message=F.col("weight"),
        max_steps=steps,
        **options,
    )


def plain_edge_program(values, edges, steps):
    values, edges = dict(values), [list(e) for e in edges]
    for step in range(steps):
        if step:
            for name in values:
                values[name] += sum(w for _, d, w in edges if d == name)
        for e in edges:
            e[2] = e[2] // 2 + values[e[0]] + step
    return values, sorted(tuple(e) for e in edges)


@pytest.mark.parametrize("edges_per_block", [1_000_000, 2])
def test_steps_set_the_values_of_edges(spark, edges_per_block):
    rows = [("A", "B", 8), ("A", "C", 5), ("A", "D", 1), ("B", "C", 9), ("C", "A", 2), ("A", "B", 3)]
    start = {"A": 1, "B": 0, "C": 4, "D": 7}
    v = spark.createDataFrame(list(start.items()), "id string, value long")
    e = spark.createDataFrame(rows, "src string, dst string, weight long")
    for steps in (1, 2, 5):
        result = edge_program(v, e, steps, edges_per_block=edges_per_block)
        values, edges = plain_edge_program(start, rows, steps)
        assert {r.id: r.value for r in result.vertices.collect()} == values
        assert sorted(tuple(r) for r in result.edges.select("src", "dst", "weight").collect()) == edges


def test_edges_get_the_ids_of_their_sources_where_they_lie(spark):
    from webloom.session import planning

    v, e = graph(spark, "ABCD", "AB BC CA CD")
    with planning(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        edges = edge_program(v.withColumn("value", F.lit(1)), e.withColumn("weight", F.lit(2)), 2).edges
        plan = edges._jdf.queryExecution().executedPlan().toString()
    # Only the look-up of the destinations shuffles, and no end is counted.
    assert "Aggregate" not in plan and plan.count("Exchange") <= 2
    assert sorted(r.src + r.dst for r in edges.collect()) == ["AB", "BC", "CA", "CD"]


def test_edges_of_sleeping_sources_keep_their_values(spark):
    v, e = graph(spark, "ABC", "AB BC CA")
    result = run_vertex_program(
        v.withColumn("value", F.lit(0)),
        e.withColumn("seen", F.lit(0)),
        update=lambda step, g: {"value": F.lit(step)},
        edge_update=lambda step, g: {"seen": F.lit(step + 1)},
        message=F.when((F.col("id") == "A") & (F.col("value") == 0), F.lit(1)),
        combine=F.max,
        halt=lambda step, g: F.lit(True),
    )
    # Only B is woken, by the message of A.
    assert {(r.src, r.dst): r.seen for r in result.edges.collect()} == {("A", "B"): 1, ("B", "C"): 2, ("C", "A"): 1}
    with pytest.raises(ValueError, match="no edge has"):
        run_vertex_program(v, e, update=lambda s, g: {}, edge_update=lambda s, g: {"w": F.lit(1)}, message=F.lit(1), max_steps=1)
    with pytest.raises(ValueError, match="no edge has"):
        run_vertex_program(v, e, update=lambda s, g: {}, edge_update=lambda s, g: {"src": F.lit("A")}, message=F.lit(1), max_steps=1)
    assert pagerank(v, e).edges is None


def test_one_exchange_a_superstep_with_edge_values(spark):
    from webloom.operators import vertexprogram as VP
    from webloom.session import planning

    v, e = graph(spark, "ABCD", "AB BC CA CD")
    layout = VP._Layout(spark, v.withColumn("x", F.lit(1.0)), e.withColumn("w", F.lit(1.0)), "error", 4, 1_000_000)
    with planning(spark, {**layout.settings(), "spark.sql.autoBroadcastJoinThreshold": -1}):
        state = layout.vertices.withColumns({"_active": F.lit(True), "_ran": F.lit(True)})
        same = F.col("_key") == F.col("_src")
        changed = layout.edges.join(state, same)
        assert "Exchange" not in changed._jdf.queryExecution().executedPlan().toString()
        layout.update_edges(state, {"w": F.col("w") / 2}, F.col("w"))
        inbox = VP._inbox(layout, state, F.col("w"), F.sum, None, 1, None, layout.carried())
        joined = state.join(inbox, F.col("_key") == F.col("_dst"), "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    layout.release()
    assert plan.count("Exchange hashpartitioning") == 1


def random_graph(spark, n, degree, seed):
    rng = random.Random(seed)
    names = [f"v{k}" for k in range(n)]
    edges = [(a, rng.choice(names)) for a in names if not a.endswith("3") for _ in range(rng.randint(1, degree))]
    return names, edges


def frames(spark, names, edges):
    return spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(edges, "src string, dst string")


def plain_ranks(names, edges, damping=0.85, steps=200):
    """Power iteration long past convergence."""
    links = [(a, b) for a, b in edges if a != b]
    degree = Counter(a for a, _ in links)
    score = dict.fromkeys(names, 1 / len(names))
    for _ in range(steps):
        dead = sum(v for k, v in score.items() if not degree[k])
        new = dict.fromkeys(names, (1 - damping + damping * dead) / len(names))
        for a, b in links:
            new[b] += damping * score[a] / degree[a]
        score = new
    return score


def scores_of(result):
    return {r.id: r.score for r in result.vertices.collect()}


def test_ranks_resumed_after_a_small_change(spark):
    # Links lead to near vertices, so a change reaches far ones only when it is small.
    rng, n = random.Random(3), 3000
    names = [f"v{k}" for k in range(n)]
    edges = [(f"v{k}", f"v{(k + rng.randint(1, 6)) % n}") for k in range(n) for _ in range(rng.randint(1, 4))]
    changed = [(a, f"v{int(a[1:]) + 7}") for a, _ in edges[:12]] + edges[12:]
    now = frames(spark, names, changed)
    before = pagerank(*frames(spark, names, edges), tolerance=1e-6).vertices
    resumed = resume_pagerank(*now, before, tolerance=1e-5)
    exact = plain_ranks(names, changed)
    assert sum(abs(v - exact[i]) for i, v in scores_of(resumed).items()) < 1e-5 / 0.15
    pushed = [h["pushed_edges"] for h in resumed.history]
    # All edges carry the last scores once; then the change alone spreads, and dies away.
    assert pushed[0] == len(changed) and len(pushed) > 5 and max(pushed[1:]) < len(changed) / 10
    again = resume_pagerank(*now, resumed.vertices, tolerance=1e-5)
    assert again.superstep <= 3 and sum(h["pushed_edges"] for h in again.history[1:]) < len(changed) / 10


def test_ranks_resumed_with_new_and_lost_vertices(spark):
    names, edges = random_graph(spark, 60, 4, 5)
    before = pagerank(*frames(spark, names, edges)).vertices
    kept = names[5:] + ["new", "newer"]
    linked = [e for e in edges if set(e) <= set(kept)] + [("new", "v7"), ("v9", "new"), ("v9", "v9")]
    now, want = frames(spark, kept, linked), plain_ranks(kept, linked, 0.5)
    options = {"damping": 0.5, "tolerance": 1e-7}
    got = scores_of(resume_pagerank(*now, before, **options))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    fresh = scores_of(resume_pagerank(*now, before.limit(0), edges_per_block=2, **options))
    assert all(abs(fresh[k] - want[k]) < 1e-6 for k in want)
    assert resume_pagerank(*frames(spark, [], []), before).vertices.count() == 0
    with pytest.raises(ValueError):
        resume_pagerank(*now, before, damping=2)
