import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from supportgraph.operators import ivf
from supportgraph.operators.search import exact_topk, recall

DIM = 16


def clustered(n, seed, centres=40, spread=0.15):
    random = np.random.default_rng(seed)
    middles = np.random.default_rng(1).normal(size=(centres, DIM))
    return middles[random.integers(0, centres, n)] + spread * random.normal(size=(n, DIM))


def table(spark, name, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{name} long, embedding array<double>")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    tickets, queries = table(spark, "ticketId", clustered(4000, 2)), table(spark, "query_id", clustered(200, 3))
    quantizer = ivf.train(tickets, DIM)
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    ivf.write_lists(ivf.build_lists(tickets, quantizer), quantizer, path)
    return tickets, queries, ivf.read_lists(spark, path)


def rows(df):
    return sorted((r.query_id, r["rank"], r.ticketId, round(r.score, 8)) for r in df.collect())


def test_every_row_is_indexed(data):
    tickets, _, index = data
    assert sorted(r.ticketId for r in index.entries.select("ticketId").collect()) == list(range(4000))
    assert index.entries.select("list").distinct().count() > 50


def test_little_is_looked_at_and_little_is_missed(data):
    tickets, queries, index = data
    found = recall(ivf.ivf_topk(queries, index, 5), exact_topk(queries, tickets, 5, DIM)).agg(F.avg("recall")).first()[0]
    share = ivf.looked_at(queries, index).agg(F.avg("share")).first()[0]
    assert found >= 0.95 and share <= 0.1


@pytest.mark.parametrize("mode,floor", [("normalized", None), ("raw", 0.8)])
def test_all_lists_and_no_short_list_is_the_exact_search(data, mode, floor):
    tickets, queries, index = data
    found = ivf.ivf_topk(queries, index, 4, floor, mode, probes=10**6, refine=10**6)
    assert rows(found) == rows(exact_topk(queries, tickets, 4, DIM, floor, mode))


def test_a_list_with_most_tickets_is_cut(spark, data, monkeypatch):
    monkeypatch.setattr(ivf, "SEGMENT_BYTES", 50 * 8 * DIM)
    _, queries, _ = data
    hot = np.concatenate([clustered(500, 4), np.repeat(clustered(1, 5), 900, axis=0)])
    tickets = table(spark, "ticketId", hot)
    quantizer = ivf.train(tickets, DIM, lists=6)
    index = ivf.ListIndex(ivf.build_lists(tickets, quantizer), quantizer)
    found = ivf.ivf_topk(queries, index, 3, probes=6, refine=10**6)
    assert rows(found) == rows(exact_topk(queries, tickets, 3, DIM))


def test_only_the_given_tickets(spark, data):
    tickets, queries, index = data
    some = tickets.where("ticketId % 3 = 0")
    found = ivf.ivf_topk(queries, index, 3, probes=10**6, refine=10**6, tickets=some)
    assert rows(found) == rows(exact_topk(queries, some, 3, DIM))


def test_unusable_vectors_and_empty_tables(spark, data):
    _, queries, index = data
    odd = spark.createDataFrame(
        [("a", [1.0] * DIM), ("zero", [0.0] * DIM), ("short", [1.0]), ("none", None), (None, [1.0] * DIM)],
        "ticketId string, embedding array<double>",
    )
    quantizer = ivf.train(odd, DIM)
    own = ivf.ListIndex(ivf.build_lists(odd, quantizer), quantizer)
    assert {r.ticketId for r in ivf.ivf_topk(queries, own, 3).collect()} == {"a"}
    assert ivf.ivf_topk(queries.limit(0), index, 3).collect() == [] == ivf.ivf_topk(queries, index, 0).collect()
    nothing = ivf.train(odd.limit(0), DIM)
    empty = ivf.ListIndex(ivf.build_lists(odd.limit(0), nothing), nothing)
    assert ivf.ivf_topk(queries, empty, 3).collect() == []
    assert ivf.looked_at(queries, empty).agg(F.max("share")).first()[0] == 0


def test_codes_approximate_the_vectors():
    values = clustered(3000, 6)
    units = values / np.linalg.norm(values, axis=1)[:, None]
    quantizer = ivf.Quantizer(ivf.kmeans(units, 40, True, 1), np.zeros((2, 1, 8)))
    left = units - quantizer.centroids[ivf.nearest(units, quantizer.centroids)]
    quantizer = ivf.Quantizer(quantizer.centroids, np.stack([ivf.kmeans(left[:, j * 8 : j * 8 + 8], 64, False, j) for j in (0, 1)]))
    lists, codes = quantizer.encode(units)
    query = units[:50]
    rough = query @ quantizer.centroids[lists].T + sum(quantizer.tables(query)[:, j].take(codes[:, j], axis=1) for j in (0, 1))
    # Six bits for eight dimensions leave no more than this share of a normal residual.
    assert np.abs(rough - query @ units.T).mean() < 2 ** (-6 / 8) * np.abs(query @ left.T).mean()


def test_of_equal_tickets_the_first_are_found(spark):
    """More copies in a list than its short list holds."""
    values = np.concatenate([clustered(60, 7), np.repeat(clustered(1, 8), 300, axis=0)])[::-1]
    tickets = table(spark, "ticketId", values)
    queries = tickets.withColumnRenamed("ticketId", "query_id")
    quantizer = ivf.train(tickets, DIM, lists=4)
    index = ivf.ListIndex(ivf.build_lists(tickets, quantizer), quantizer)
    assert rows(ivf.ivf_topk(queries, index, 3, probes=4)) == rows(exact_topk(queries, tickets, 3, DIM))


def test_many_shelves_and_tasks_give_the_same_hits(spark, data, monkeypatch):
    tickets, queries, index = data
    one = rows(ivf.ivf_topk(queries, index, 5))
    monkeypatch.setattr(ivf, "SHELF_BYTES", 300 * 8 * DIM)
    monkeypatch.setattr(ivf, "TASK_PAIRS", 1000)
    assert rows(ivf.ivf_topk(queries, index, 5)) == one
    found = ivf.ivf_topk(queries, index, 5, 0.9, probes=10**6, refine=10**6)
    assert rows(found) == rows(exact_topk(queries, tickets, 5, DIM, 0.9))


def test_shelves_hold_neighbours_and_no_more_than_fits():
    centres = np.array([[10.0 * (i % 4), i % 3] for i in range(40)])
    shelf = ivf.shelves(centres, np.ones(40), 12)
    assert np.bincount(shelf).max() <= 12
    assert all(len({tuple(c)[0] for c in centres[shelf == s]}) == 1 for s in set(shelf))
    assert list(ivf.shelves(centres[:1], np.array([99.0]), 12)) == [0]


def test_a_query_is_sent_to_a_shelf_once(spark, data, monkeypatch):
    """Whatever the number of lists it looks into there."""
    _, queries, index = data
    sent, union = [], type(queries).unionByName
    monkeypatch.setattr(type(queries), "unionByName", lambda own, other: sent.append(other.count()) or union(own, other))
    ivf.ivf_topk(queries, index, 5, probes=30)
    assert sent == [200]


def test_nearest_is_that_of_double_precision():
    """Centres that differ by less than single precision can tell, and equal ones."""
    random = np.random.default_rng(4)
    rows, centres = random.normal(size=(500, DIM)), random.normal(size=(40, DIM))
    centres = np.concatenate([centres, centres + 1e-9 * random.normal(size=centres.shape), centres])
    want = np.array([(centres @ r - (centres**2).sum(axis=1) / 2).argmax() for r in rows])
    got = ivf.nearest(rows, centres)
    away = ((rows - centres[got]) ** 2).sum(axis=1) - ((rows - centres[want]) ** 2).sum(axis=1)
    assert (got < 80).all() and away.max() < 1e-12


def test_training_in_tasks_gives_the_same(spark, data, monkeypatch):
    tickets, _, index = data
    monkeypatch.setattr(ivf, "DRIVER_PAIRS", 0)
    rounds, deal = [], ivf._nearest_in_tasks
    monkeypatch.setattr(ivf, "_nearest_in_tasks", lambda *args: lambda centres, find=deal(*args): rounds.append(len(centres)) or find(centres))
    found = ivf.train(tickets, DIM)
    assert len(rounds) == 13
    assert np.array_equal(found.centroids, index.quantizer.centroids) and np.array_equal(found.books, index.quantizer.books)


def test_a_cell_is_looked_at_by_many_queries_at_once_and_ties_of_codes_are_all_in(monkeypatch):
    """With one code all tickets of a list tie, so its short list of five holds them all."""
    values = clustered(3000, 2)
    units = values / np.linalg.norm(values, axis=1)[:, None]
    own = ivf.Quantizer(ivf.kmeans(units, 30, True, 1), np.zeros((2, 1, 8)))
    lists, codes = own.encode(units)
    shelf = ivf.Shelf(lists, lists, pa.array(np.arange(3000)), units, codes, own)
    calls, look = [], ivf.Shelf._look
    monkeypatch.setattr(ivf.Shelf, "_look", lambda self, cell, who, found, short: calls.append(cell) or look(self, cell, who, found, short))
    who, cells = np.repeat(np.arange(3000), 30), np.tile(np.arange(30), 3000)
    row, scores, names = shelf.best(units, who, cells, 3, 5, None, False)
    assert len(calls) <= 3 * 30
    exact = np.sort(np.round(units @ units.T, 9), axis=1)[:, ::-1][:, :3]
    assert np.abs(scores.reshape(-1, 3) - exact).max() < 2e-9
