from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from supportgraph.operators import quality
from supportgraph.operators.edges import (
    attach_vectors,
    build_edges,
    dangling_of,
    edge_counts,
    edges_of,
    expand,
    resolve_references,
    walk,
    without_foreign_keys,
)
from supportgraph.operators.quality import (
    dangling_references,
    duplicate_keys,
    require_unique,
    split_duplicates,
    valid_vectors,
    vector_rejects,
)
from supportgraph.operators.search import Planes
from supportgraph.options import RetrievalOptions
from supportgraph.plans.build import (
    build,
    current_version,
    key_violations,
    load_index,
    reference_report,
)
from supportgraph.plans.retrieve import find_tickets, retrieve
from supportgraph.sources.tables import load_rejects


def test_edges(graph):
    edges = build_edges(graph)
    counts = {(r.edge_type, r.src_label): r.n for r in edge_counts(edges).collect()}
    assert counts == {
        ("SUBMITS", "user"): 5,
        ("ASSIGNED_TO", "user"): 4,
        ("HAS_STATUS", "ticket"): 5,
        ("HAS_PRIORITY", "ticket"): 5,
        ("HAS_CATEGORY", "ticket"): 4,
        ("CONTAINS", "ticket"): 12,
        ("POSTS", "user"): 10,
        ("HAS_CATEGORY", "category"): 1,
        ("REFERENCED_BY", "article"): 2,
    }


def test_edge_directions(graph):
    edges = {(r.src, r.edge_type, r.dst) for r in build_edges(graph).collect()}
    assert ("u2", "SUBMITS", "t1") in edges
    assert ("t1", "HAS_STATUS", "s2") in edges
    assert ("c1", "HAS_CATEGORY", "a1") in edges
    assert ("t1", "HAS_CATEGORY", "c1") in edges
    assert ("a1", "REFERENCED_BY", "m2") in edges


def test_expand(graph):
    edges = build_edges(graph)
    start = graph.category.select("categoryId")
    articles = expand(start, edges, "categoryId", "HAS_CATEGORY", "articleId", to_label="article")
    assert [r.articleId for r in articles.collect()] == ["a1"]
    comments = expand(articles, edges, "articleId", "REFERENCED_BY", "commentId")
    tickets = expand(comments, edges, "commentId", "CONTAINS", "ticketId", direction="in")
    assert [(r.categoryId, r.ticketId) for r in tickets.collect()] == [("c1", "t1")]
    authors = expand(
        graph.comment.where("ticketId = 't2'").select("commentId"),
        edges, "commentId", "POSTS", "userId", direction="in", optional=True,
    )
    assert {(r.commentId, r.userId) for r in authors.collect()} == {("m7", "u2"), ("m8", None)}


def test_foreign_keys_are_dropped(graph):
    assert "statusId" not in without_foreign_keys(graph.ticket, "ticket").columns
    assert without_foreign_keys(graph.user, "user").columns == graph.user.columns


def test_reports(graph):
    report = {(r.label, r.key, r.column, r.value) for r in reference_report(graph).collect()}
    assert report == {
        ("ticket", "t2", "categoryId", "c9"),
        ("comment", "m3", "authorUserId", "u9"),
        ("comment", "m8", "authorUserId", "u9"),
        ("article", "a2", "categoryId", "c7"),
    }
    assert key_violations(graph).count() == 0
    dangling = dangling_references(graph.ticket, "categoryId", graph.category, "categoryId")
    assert [r.ticketId for r in dangling.collect()] == ["t2"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "id int, x string")
    assert [tuple(r) for r in duplicate_keys(df, "id").collect()] == [(1, 2)]
    kept, held = split_duplicates(df, "id")
    assert {r.x for r in kept.collect()} == {"c", "d"}
    assert {r.x for r in held.collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="duplicate keys"):
        require_unique(df, "id")
    assert require_unique(kept, "id") is kept


def test_large_tables_are_counted_by_more_tasks(spark, monkeypatch):
    """Before, the number of tasks stayed, whatever the number of keys; equal and null keys are dealt, too."""
    rows = [(i % 400, "x") for i in range(700)] + [(7, "x")] * 300 + [(None, "x"), (None, "x"), (5, None)]
    df = spark.createDataFrame(rows, "id int, part string")
    few = duplicate_keys(df, "id", "part")
    monkeypatch.setattr(quality, "ROWS_OF_A_TASK", 20)
    many = duplicate_keys(df, "id", "part")
    assert many.schema == few.schema
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    assert many.rdd.getNumPartitions() == 51
    kept, held = split_duplicates(df, "id", "part")
    assert (kept.count(), held.count()) == (103, 900)



def test_vector_checks(spark):
    rows = [
        ("ok", [1.0, 0.0]), ("short", [1.0]), ("zero", [0.0, 0.0]), ("none", None),
        ("hole", [1.0, None]), ("nan", [float("nan"), 1.0]),
    ]
    df = spark.createDataFrame(rows, "ticketId string, embedding array<double>")
    assert [r.ticketId for r in valid_vectors(df, 2).collect()] == ["ok"]
    assert {r.ticketId: r.error for r in vector_rejects(df, 2).collect()} == {
        "short": "dimension", "zero": "zero", "none": "missing", "hole": "element",
        "nan": "element",
    }


def test_attach_vectors(spark):
    vectors = spark.createDataFrame(
        [("t1", [1.0]), ("t9", [9.0])], "ticketId string, embedding array<double>"
    )
    bare = spark.createDataFrame([("t1",), ("t2",)], "ticketId string")
    got = {r.ticketId: r.embedding for r in attach_vectors(bare, vectors).collect()}
    assert got == {"t1": [1.0], "t2": None}
    full = bare.withColumn("embedding", F.array(F.lit(5.0)))
    got = {r.ticketId: r.embedding for r in attach_vectors(full, vectors).collect()}
    assert got == {"t1": [1.0], "t2": [5.0]}


def test_build(spark, graph, csv_paths, tmp_path):
    root = str(tmp_path / "built")
    full = build(spark, graph, root, dim=32, rejects=load_rejects(spark, csv_paths), bands=2, bits=3)
    assert full.ticket.where("embedding is not null").count() == 4
    version = current_version(spark, root)
    edges = spark.read.parquet(f"{version}/edges")
    assert edges.count() == build_edges(graph).count()
    reasons = {(r.label, r.key, r.reason) for r in spark.read.parquet(f"{version}/rejects").collect()}
    assert ("user", None, "no key") in reasons and ("ticket", "t5", "vector") in reasons
    assert ("ticket", "t2", "dangling reference") in reasons
    index = load_index(spark, root)
    assert index.planes == Planes(32, 2, 3) and index.entries.count() == 8

    # A question equal to a ticket shares all its buckets.
    question = full.ticket.where("ticketId = 't1'").select(
        F.lit("q").alias("query_id"), "embedding"
    )
    options = RetrievalOptions(top_k=1, min_score=0.9, dim=32)
    found = retrieve(question, full, options, index)
    assert {(r.ticketId, r.solutionComment.commentId) for r in found.collect()} == {
        ("t1", "m4"), ("t1", "m6"),
    }
    open_only = full.ticket.where("ticketId = 't4'").select(
        F.lit("q").alias("query_id"), "embedding"
    )
    for mode in ("post", "pre"):
        hits = find_tickets(open_only, full, options.updated(filter_mode=mode), index)
        assert ("t4" in {r.ticketId for r in hits.collect()}) == (mode == "post")

    # A later build may read what it replaces, and one that fails leaves it as it is.
    build(spark, full, root, dim=32, bands=2, bits=3)
    second = current_version(spark, root)
    assert second != version and spark.read.parquet(f"{second}/nodes/ticket").count() == 5
    twice = replace(full, user=full.user.unionByName(full.user))
    with pytest.raises(ValueError, match="user"):
        build(spark, twice, root, dim=32)
    assert current_version(spark, root) == second


def test_build_refuses_duplicate_keys(spark, graph, tmp_path):
    twice = replace(graph, status=graph.status.unionByName(graph.status))
    with pytest.raises(ValueError, match="status"):
        build(spark, twice, str(tmp_path / "built"), dim=8)


def plain_walk(start, links, most):
    """Breadth first from one node."""
    depth, line = {start: 0}, [start]
    for node in line:
        if depth[node] == most:
            continue
        for a, b in links:
            if a == node and b not in depth:
                depth[b] = depth[node] + 1
                line.append(b)
    return {(node, d) for node, d in depth.items() if d}


@pytest.mark.parametrize("direction,most,least", [("out", 4, 1), ("in", 3, 1), ("both", 5, 2), ("both", 1, 1)])
def test_walks_find_the_shortest_way(spark, direction, most, least):
    import random

    random.seed(most)
    nodes = [("xy"[i % 2], f"n{i // 2}") for i in range(24)]
    pairs = [(random.choice(nodes), random.choice(nodes)) for _ in range(40)] + [(nodes[0], n) for n in nodes[:12]]
    pairs += [(nodes[3], nodes[4]), (nodes[4], nodes[3])]  # a cycle
    rows = [(a[1], b[1], "E", a[0], b[0]) for a, b in pairs]
    edges = spark.createDataFrame(rows + rows[:5], "src string, dst string, edge_type string, src_label string, dst_label string")
    starts = [nodes[0], nodes[5], nodes[0]]
    links = {"out": pairs, "in": [(b, a) for a, b in pairs], "both": pairs + [(b, a) for a, b in pairs]}[direction]
    found = walk(spark.createDataFrame([*starts, ("x", None)], "label string, node string"), edges, most, least, direction)
    got = [((r.start_label, r.start), (r.label, r.node), r.depth) for r in found.collect()]
    want = {(s, node, d) for s in set(starts) for node, d in plain_walk(s, links, most) if d >= least}
    assert len(got) == len(set(got)) and set(got) == want
    assert walk(spark.createDataFrame([], "label string, node string"), edges, 3).collect() == []
    assert walk(spark.createDataFrame([nodes[0]], "label string, node string"), edges, 3, edge_types=["none"]).collect() == []


def test_references_are_looked_up_once(spark, graph):
    resolved = resolve_references(graph)
    assert resolved.where("ref IS NULL").count() == 0
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    assert edges_of(resolved).count() + dangling_of(resolved).count() == resolved.count()


def test_references_are_not_shuffled_where_all_or_few_are_unknown(spark, graph):
    from supportgraph.operators.edges import build_edges, resolve_references

    plan = resolve_references(graph)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    one = build_edges(graph).where("edge_type = 'SUBMITS'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in one  # a walk along one kind reads that kind only


def test_a_node_many_starts_reach_is_one_row_on_its_way(spark, monkeypatch):
    from supportgraph.operators import edges as module

    written, keep = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append((name, keep(df, name))) or written[-1][1])
    starts = [("a", f"s{i:03d}") for i in range(150)]
    links = [("a", s, "b", "hub", "E") for _, s in starts] + [("b", "hub", "c", f"n{i}", "E") for i in range(20)]
    edges = spark.createDataFrame(links, "src_label string, src string, dst_label string, dst string, edge_type string")
    found = module.walk(spark.createDataFrame(starts, "label string, node string").coalesce(1), edges, 2)
    assert found.count() == 150 * 21
    assert sum(df.count() for name, df in written if name == "walk") < 150 + 21 * 150 / 8


def test_a_step_of_many_links_is_several_jobs_that_drop_their_shuffles(spark, monkeypatch):
    import random

    from supportgraph.operators import edges as module

    random.seed(most := 3)
    nodes = [("xyz"[i % 3], f"n{i // 3}") for i in range(60)]
    pairs = [(random.choice(nodes), random.choice(nodes)) for _ in range(90)] + [(nodes[0], n) for n in nodes[:30]]
    rows = [(a[1], b[1], "E", a[0], b[0]) for a, b in pairs]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, src_label string, dst_label string")
    starts = [nodes[0], nodes[5], nodes[7]]
    settings, jobs, keep = set(), [], module.materialize

    def watch(df, name):
        settings.add(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        jobs.append(name)
        return keep(df, name)

    monkeypatch.setattr(module, "materialize", watch)
    monkeypatch.setattr(module, "JOB_LINKS", 60)
    found = module.walk(spark.createDataFrame(starts, "label string, node string"), edges, most, direction="both")
    links = pairs + [(b, a) for a, b in pairs]
    got = [((r.start_label, r.start), (r.label, r.node), r.depth) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, n, d) for s in starts for n, d in plain_walk(s, links, most)}
    assert settings == {"true"} and jobs.count("walk") > most + 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
