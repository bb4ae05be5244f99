"""Golden orders, errors, and every registered query against its SQL."""

import math
from dataclasses import replace
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions import cosine_distance, l2_distance, manhattan_distance, register
from vicinal.operators import AnnIndex, knn_join, near_join, nearest
from vicinal.operators import index as index_module
from vicinal.operators.graph import ShardGraph
from vicinal.plans import choose_strategy, rewrite, search, sql
from vicinal.queries import oracle_sql, queries
from vicinal.sources import clear_scratch, scratch, stored
from vicinal.streaming import ingest

DATA = "/root/testdata/sf0.001"
Q = [3.0, 3.0, 3.0]
ROWS = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 1.0, 1.0]), (4, None), (5, [1.0, 2.0, 4.0])]
ORDER = {"l2": [2, 5, 3, 1], "cosine": [3, 2, 5, 1], "manhattan": [2, 5, 1, 3]}


def small(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, val array<float>")


@pytest.mark.parametrize("metric", ORDER)
def test_golden_order(spark, tmp_path, metric):
    df = small(spark)
    assert [r.id for r in nearest(df, "val", Q, metric=metric, id_column="id").collect()] == [*ORDER[metric], 4]
    index = AnnIndex.build(df.filter("id < 5"), f"file://{tmp_path}/i", id_column="id", column="val", dims=3, m=3, metric=metric)
    index.insert(df.filter("id = 5"), id_column="id", column="val")
    assert [r.row_id for r in index.search(Q).orderBy("rank").collect()] == ORDER[metric]
    index.delete(df, "id")
    assert index.count() == 0 and index.search(Q).count() == 0
    index.insert(df, id_column="id", column="val")
    assert [r.row_id for r in AnnIndex.load(spark, index.path).search(Q).orderBy("rank").collect()] == ORDER[metric]


def test_golden_values(spark):
    rows = small(spark).select("id", l2_distance(F.col("val"), Q), cosine_distance(F.col("val"), Q), manhattan_distance(F.col("val"), Q)).collect()
    found = {r[0]: r[1:] for r in rows}
    assert found[1] == pytest.approx((3.741657, 0.225403, 6), abs=1e-5)
    assert found[5] == pytest.approx((2.449490, 0.118083, 4), abs=1e-5)
    assert found[4] == (None, None, None)


def test_empty_and_truncated(spark, tmp_path):
    index = AnnIndex.build(small(spark, []), f"file://{tmp_path}/i", id_column="id", column="val", dims=3, m=3)
    assert index.search(Q).count() == 0
    index.insert(small(spark), id_column="id", column="val")
    index.truncate()
    index.insert(small(spark, [(4, [4.0, 5.0, 6.0]), (5, [1.0, 2.0, 3.0]), (6, [7.0, 8.0, 9.0])]), id_column="id", column="val")
    assert [r.row_id for r in index.search(Q).orderBy("rank").collect()] == [5, 4, 6]
    assert index.search(None).count() == 0


def test_errors(spark, tmp_path):
    with pytest.raises(Exception, match="different array dimensions 2 and 3"):
        small(spark, [(1, [1.0, 2.0])]).select(l2_distance(F.col("val"), Q)).collect()
    with pytest.raises(Exception, match="null element"):
        small(spark, [(1, [1.0, None, 2.0])]).select(l2_distance(F.col("val"), Q)).collect()
    at = f"file://{tmp_path}/e"
    with pytest.raises(ValueError, match="requires 'dims'"):
        AnnIndex.build(small(spark), at, id_column="id", column="val")
    with pytest.raises(ValueError, match="m must"):
        AnnIndex.build(small(spark), at, id_column="id", column="val", dims=3, m=0)
    with pytest.raises(ValueError, match="unsupported metric"):
        AnnIndex.build(small(spark), at, id_column="id", column="val", dims=3, metric="dot")
    with pytest.raises(Exception, match="Wrong number of dimensions: 3 instead of 4 expected"):
        AnnIndex.build(small(spark), at, id_column="id", column="val", dims=4)
    index = AnnIndex.build(small(spark), f"file://{tmp_path}/i", id_column="id", column="val", dims=3)
    with pytest.raises(ValueError, match="Wrong number of dimensions: 2 instead of 3 expected"):
        index.search([1.0, 2.0])
    with pytest.raises(ValueError, match="Inconsistency"):
        index.alter(dims=4)
    index.alter(efsearch=8)
    assert AnnIndex.load(spark, index.path).options.efsearch == 8
    index.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no index"):
        AnnIndex.load(spark, index.path)


def test_zero_and_empty_vectors(spark):
    row = spark.range(1).select(cosine_distance([0.0], [1.0]), l2_distance(F.array().cast("array<float>"), F.array().cast("array<float>"))).first()
    assert math.isnan(row[0]) and row[1] == 0


def test_sql_surface(spark):
    register(spark)
    assert spark.sql("SELECT l2_distance(array(0, 0), array(3, 4))").first()[0] == 5
    assert math.isnan(spark.sql("SELECT cosine_distance(array(0, 0), array(3, 4))").first()[0])
    assert rewrite("SELECT a <-> array[1,2] FROM t WHERE x = '<->'") == "SELECT l2_distance(a, array(1,2)) FROM t WHERE x = '<->'"
    assert rewrite("a <=> b", cosine=False) == "a <=> b"
    small(spark).createOrReplaceTempView("t")
    found = sql(spark, "SELECT id FROM t ORDER BY val <~> array[3,3,3] NULLS LAST, id LIMIT 2").collect()
    assert [r.id for r in found] == [2, 5]


# Statements and what Spark gets of them.
STATEMENTS = {
    "SELECT 'array[1,2]' -- array[1]\n, /* a <-> b */ \"x <-> y\"": None,
    "SELECT 'it''s <-> x', `a <-> b` FROM t": None,
    "v <-> -1": "l2_distance(v, -1)",
    "y[1][2] <-> z": "l2_distance(y[1][2], z)",
    "array[[1,2],[3,4]] <-> v": "l2_distance(flatten(array(array(1,2),array(3,4))), v)",
    "v <-> '{1,2}'::real[]": "l2_distance(v, array(1,2)::ARRAY<FLOAT>)",
    "'{1,2,3}' <=> v::double precision[]": "cosine_distance(array(1,2,3), v::ARRAY<DOUBLE>)",
    "f(x <-> y, 2) <~> g(z)[1]": "manhattan_distance(f(l2_distance(x, y), 2), g(z)[1])",
    "WHERE (a) <-> (b) < 3": "WHERE l2_distance((a), (b)) < 3",
    "a.b <-> `q r`.`s`": "l2_distance(a.b, `q r`.`s`)",
}


@pytest.mark.parametrize("text", STATEMENTS)
def test_statements(text):
    assert rewrite(text) == (STATEMENTS[text] or text)


def test_statements_run(spark):
    small(spark).createOrReplaceTempView("t")
    found = sql(spark, "SELECT id, val <-> '{3,3,3}' AS a, '{3,3,3}'::real[] <-> val AS b, val <-> array[[3],[3],[3]] AS c FROM t WHERE id = 5").first()
    assert found.a == found.b == found.c == pytest.approx(6**0.5)
    assert sql(spark, "SELECT 'array[1,2]' AS x -- <->").first().x == "array[1,2]"


@pytest.mark.parametrize("norm", [1, 100, 10_000])
@pytest.mark.parametrize("metric", ["l2", "cosine", "manhattan"])
def test_joins_of_near_duplicates_by_brute_force(spark, norm, metric):
    """Vectors that hardly differ: the order is that of the differences, not of what products leave of them."""
    rng = np.random.default_rng(norm)
    data = (norm * (1 + rng.normal(size=(600, 64)) * 1e-6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    asked = df.filter("id % 60 = 0")
    exact = data.astype(np.float64)
    want, near = set(), set()
    for q in range(0, 600, 60):
        d = np.array([{"l2": math.dist(exact[q], x), "manhattan": np.abs(exact[q] - x).sum(), "cosine": 1 - (exact[q] * x).sum() / (np.sqrt((x**2).sum()) * np.sqrt((exact[q] ** 2).sum()))}[metric] for x in exact])
        kth = np.sort(d)[4]
        want.add((q, tuple(np.flatnonzero(d < kth * (1 - 1e-9) - 1e-15))))
        near |= {(q, int(i)) for i in np.flatnonzero(d < np.median(d))}
        radius = np.median(d)
    got = {}
    for r in knn_join(df, asked, 5, metric=metric, base_id="id", base_vector="val", query_id="id", query_vector="val").collect():
        got.setdefault(r.query_id, set()).add(r.base_id)
    assert all(len(got[q]) == 5 and set(ids) <= got[q] for q, ids in want)
    if metric == "l2":
        found = near_join(df, asked, radius, base_id="id", base_vector="val", query_id="id", query_vector="val").collect()
        due = {(q, i): math.dist(exact[q], exact[i]) for q in range(0, 600, 60) for i in range(600)}
        assert {(r.query_id, r.base_id) for r in found} == {pair for pair, d in due.items() if d < radius}
        assert all(r.distance == pytest.approx(due[r.query_id, r.base_id], rel=1e-9, abs=1e-12) for r in found)


def test_many_inserts_and_deletes_keep_plans_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "MOST_SMALL", 3)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    index = AnnIndex.build(df.limit(0), f"file://{tmp_path}/i", id_column="id", column="val", dims=4)
    for k in range(6):
        index.insert(df.filter(f"id >= {10 * k} AND id < {10 * k + 10}"), id_column="id", column="val")
        index.delete(df.filter(f"id = {10 * k + 3}"), "id")
        assert len(index._meta.nodes) <= 4
    live = {i for i in range(60) if i % 10 != 3}
    assert {r.row_id for r in AnnIndex.load(spark, index.path).rows().collect()} == live
    found = index.search([0.0] * 4, 5)
    best = sorted(live, key=lambda i: float((data[i].astype(np.float32) ** 2).sum()))[:5]
    assert [r.row_id for r in found.orderBy("rank").collect()] == best
    plan = index._beam([0], np.zeros((1, 4)), 4)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("Scan parquet") == 2 and plan.count("MapInArrow") == 1


def test_failures_have_their_names(spark, tmp_path, monkeypatch):
    index = AnnIndex.build(small(spark), f"file://{tmp_path}/i", id_column="id", column="val", dims=3)
    broken = spark.read.parquet(f"{index.path}/nodes/gen=1").withColumn("links", F.lit(b"\xff\xff\xff\x7f" * 12))
    broken.write.parquet(f"{index.path}/nodes/gen=9")
    bad = AnnIndex(spark, index.path, replace(index._meta, nodes={"9": 4}))
    with pytest.raises(Exception, match="HNSW index search failed"):
        bad.search(Q, 2).collect()


def test_graph_invariants():
    rng = np.random.default_rng(9)
    graph = ShardGraph(rng.normal(size=(300, 6)), "l2", m=4, efconstruction=12)
    for node, links in enumerate(graph.links):
        assert len(links) <= 8 and node not in links and len(set(links.tolist())) == len(links)
        assert ((links >= 0) & (links < 300)).all()


def test_search_reads_shards_in_place(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, val array<float>")
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=2, shard_rows=10)
    plan = index._beam([0], np.zeros((1, 2)), 4)._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert "Exchange" not in plan and [r.row_id for r in index.search([0.0, 1.0], 3).orderBy("rank").collect()] == [0, 1, 2]


def test_strategy(spark, tmp_path):
    df = small(spark)
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=3)
    assert choose_strategy(10, 5, index) == "exact" and choose_strategy(10**7, 5, index) == "ann" and choose_strategy(10**7, None, index) == "exact"
    for mode in ("exact", "ann"):
        assert [r.id for r in search(df, "val", Q, 3, id_column="id", index=index, mode=mode).collect()] == [2, 5, 3]


@pytest.mark.parametrize("metric", ORDER)
def test_wide_beam_is_exact_and_narrow_has_recall(metric):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(400, 16))
    graph = ShardGraph(data, metric, m=16, efconstruction=64)
    from vicinal.operators.exact import exact_rows

    hits = 0
    for q in rng.normal(size=(20, 16)):
        d = exact_rows(metric, q, data)
        best = np.lexsort((np.arange(400), d))[:10].tolist()
        assert [n for _, n in graph.search(q, 400)][:10] == best
        hits += len(set(best) & {n for _, n in graph.search(q, 64)})
    assert hits >= 190


def test_knn_join_ties_and_nulls(spark):
    df = small(spark, [*ROWS, (6, [1.0, 2.0, 3.0])])
    got = knn_join(df, df.filter("id in (2, 4)"), 2, base_id="id", base_vector="val", query_id="id", query_vector="val").collect()
    assert sorted((r.query_id, r.base_id, r["rank"]) for r in got) == [(2, 2, 1), (2, 6, 2)]


def test_filtered_search_grows(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 8)))], "id long, val array<float>")
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=8, m=16, efconstruction=32, efsearch=4)
    allowed = df.filter("id % 40 = 1").select(F.col("id").alias("row_id"))
    assert index.search([0.0] * 8, 5, allowed=allowed).count() == 5


def test_stream(spark, tmp_path):
    df = small(spark)
    df.write.parquet(f"{tmp_path}/in")
    index = AnnIndex.build(df.limit(0), f"file://{tmp_path}/i", id_column="id", column="val", dims=3)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    ingest(stream, index.path, id_column="id", column="val", checkpoint=f"{tmp_path}/c").awaitTermination(120)
    assert [r.row_id for r in AnnIndex.load(spark, index.path).search(Q).orderBy("rank").collect()] == ORDER["l2"]


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in map(tuple, rows)) if all(None not in tuple(r) for r in rows) else sorted(map(repr, (tuple(r[i] for i in order) for r in map(tuple, rows))))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = queries()[name](spark, DATA)
    rows = got.collect()
    if name not in oracle_sql():
        assert len(rows) == 10
        return
    assert rows
    want = con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(rows, got.columns) == canonical(want.fetchall(), want.columns)


def test_working_tables_are_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
    other = tmp_path / "vicinal" / "another-application" / "table"
    other.mkdir(parents=True)
    assert stored(small(spark), "rows").count() == len(ROWS)
    assert list(tmp_path.rglob("*.parquet"))
    assert clear_scratch(spark)
    assert not list(tmp_path.rglob("*.parquet")) and other.exists()
    assert not clear_scratch(spark)


def test_filtered_search_has_each_row_once_and_no_gaps(spark, tmp_path):
    """Queries that are done in different rounds, shards that differ: every row once, and the nearest that count."""
    rng = np.random.default_rng(11)
    data = rng.normal(size=(3000, 4)).astype(np.float32)
    data[2000:] *= 0.2  # a dense middle, in shards of its own
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    index = AnnIndex.build(df.filter("id < 2000"), f"file://{tmp_path}/i", id_column="id", column="val", dims=4, shard_rows=500, efsearch=4)
    index.insert(df.filter("id >= 2000"), id_column="id", column="val")
    index.delete(df.filter("id % 7 = 0"), "id")
    live = [i for i in range(3000) if i % 7 and (i < 30 or i % 19 == 3)]
    asked = df.filter("id % 60 = 0").select(F.col("id").alias("query_id"), F.col("val").alias("query"))
    found = {}
    for row in index.search(asked, 10, allowed=spark.createDataFrame([(i,) for i in live], "row_id long")).collect():
        found.setdefault(row.query_id, []).append(row.row_id)
    assert len(found) == 50 and all(len(set(ids)) == len(ids) == 10 for ids in found.values())
    best = {q: sorted(live, key=lambda i: math.dist(data[q], data[i]))[:10] for q in found}
    assert sum(len(set(best[q]) & set(found[q])) for q in found) >= 490


def test_beam_is_widened_to_what_the_shards_need(spark, tmp_path):
    """Many dimensions: the beam of 8 finds few of the ten nearest of 2,000 rows."""
    data = np.random.default_rng(13).normal(size=(2000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=48, efsearch=8)
    assert AnnIndex.load(spark, index.path)._meta.beam > 8
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("val").alias("query"))
    found = {(r.query_id, r.row_id) for r in index.search(asked, 10).collect()}
    best = {(q, i) for q in range(0, 2000, 20) for i in np.argsort(((data - data[q]) ** 2).sum(1), kind="stable")[:10].tolist()}
    assert len(found) == 1000 and len(found & best) >= 950


def test_joins_hold_few_pairs_at_a_time(spark, monkeypatch):
    """Parts of the queries, ties, zero vectors and ids of text, against all pairs sorted."""
    from vicinal.operators import exact

    monkeypatch.setattr(exact, "TILE_PAIRS", 100)
    monkeypatch.setattr(exact, "EXACT_PAIRS", 7)
    rng = np.random.default_rng(17)
    data = rng.integers(-2, 3, size=(300, 3)).astype(float)
    for metric in ("l2", "cosine", "manhattan"):
        best = exact.Best(metric, data[:40], 6)
        for begin in range(0, 300, 90):
            best.add(np.array([f"v{i:03}" for i in range(begin, min(300, begin + 90))], dtype=object), data[begin : begin + 90])
        got = {}
        for numbers, ids, d in best.rows(step=50):
            for q, name, x in zip(numbers.tolist(), ids.tolist(), d.tolist(), strict=True):
                got.setdefault(q, []).append((x, name))
        for q in range(40):
            d = exact.exact_rows(metric, data[q], data)
            order = np.lexsort((np.arange(300), d))[:6]
            assert [name for _, name in got[q]] == [f"v{i:03}" for i in order]
            assert np.array_equal([x for x, _ in got[q]], d[order], equal_nan=True)


def test_join_keeps_no_table_of_all_pairs():
    """4,000 queries by 10,000 rows: 320 MB for one table of their distances; the k best of each and parts are held."""
    import tracemalloc

    from vicinal.operators import exact

    rng = np.random.default_rng(19)
    wanted, have = rng.normal(size=(4000, 8)), rng.normal(size=(10_000, 8))
    tracemalloc.start()
    best = exact.Best("l2", wanted, 5)
    best.add(np.arange(10_000), have)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert set(best.ids[0].tolist()) == set(np.argsort(((have - wanted[0]) ** 2).sum(1))[:5].tolist())


@pytest.mark.parametrize("metric", ORDER)
def test_beams_of_many_queries_are_those_of_each(metric):
    rng = np.random.default_rng(23)
    data = rng.normal(size=(900, 12))
    data[5], data[700:720] = 0, data[3]  # cosine with a zero vector is NaN; equal rows
    graph = ShardGraph(data, metric, m=8, efconstruction=16)
    from vicinal.operators.exact import exact_rows

    asked = np.concatenate([data[:40], rng.normal(size=(200, 12))])
    together = graph.search_all(asked, 48, 10)
    for query, (nodes, d) in zip(asked[::7], together[::7], strict=True):
        alone = graph.search(query, 48)[:10]
        assert [n for _, n in alone] == nodes.tolist() and np.array_equal([x for x, _ in alone], d, equal_nan=True)
        assert np.array_equal(exact_rows(metric, query, data[nodes]), d, equal_nan=True)
    for node, (nodes, _) in zip(range(0, 900, 90), graph.search_all(data[::90], 900, None, np.arange(0, 900, 90)), strict=True):
        assert node not in nodes and len(nodes) >= 890
    again = ShardGraph(data, metric, 8, 16, graph.packed())
    assert all((a[0] == b[0]).all() for a, b in zip(together, again.search_all(asked, 48, 10), strict=True))


def test_one_shard_is_searched_by_several_tasks(spark, tmp_path):
    data = np.random.default_rng(29).normal(size=(600, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=6)
    found = index._beam(list(range(600)), data.astype(float), 32, 1)
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r.query_id, r.row_id) for r in found.collect()) == [(i, i) for i in range(600)]


def test_filtered_search_begins_as_wide_as_the_filter_asks(spark, tmp_path, monkeypatch):
    """A filter that leaves a sixtieth: a beam for all queries, and one more for few, where it was doubled from ten nodes on."""
    data = np.random.default_rng(31).normal(size=(3000, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, val array<float>")
    index = AnnIndex.build(df, f"file://{tmp_path}/i", id_column="id", column="val", dims=6, efsearch=16)
    rounds, beam = [], AnnIndex._beam
    monkeypatch.setattr(AnnIndex, "_beam", lambda self, ids, *a, **o: rounds.append(len(ids)) or beam(self, ids, *a, **o))
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("val").alias("query"))
    found = {(r.query_id, r.row_id) for r in index.search(asked, 10, allowed=df.filter("id % 60 = 7").select(F.col("id").alias("row_id"))).collect()}
    assert len(rounds) <= 2 and sum(rounds) <= 170
    live = np.arange(7, 3000, 60)
    best = {(q, i) for q in range(0, 3000, 20) for i in live[np.argsort(((data[live] - data[q]) ** 2).sum(1), kind="stable")[:10]].tolist()}
    assert len(found) == 1500 and len(found & best) >= 1480


def test_join_computes_few_distances_in_full(monkeypatch):
    """The first rows of a task bound the others: few pairs are subtracted in double precision, whatever the metric."""
    from vicinal.operators import exact

    rng = np.random.default_rng(37)
    for scale, spread in ((1, 1), (1e4, 1e-6)):
        have = (scale * (rng.normal(size=16) + spread * rng.normal(size=(6000, 16)))).astype(np.float32).astype(float)
        wanted = have[::60]
        for metric in ("l2", "cosine", "manhattan"):
            full, pairwise = [], exact.pairwise
            with monkeypatch.context() as patch:
                patch.setattr(exact, "pairwise", lambda m, q, b: full.append(len(q) * len(b)) or pairwise(m, q, b))  # noqa: B023
                best = exact.Best(metric, wanted, 10)
                for begin in range(0, 6000, 2500):
                    best.add(np.arange(begin, min(6000, begin + 2500)), have[begin : begin + 2500])
            assert sum(full) <= wanted.shape[0] * 6000 // 10
            for q, ids, d in zip(wanted, best.ids, best.distances, strict=True):
                own = exact.exact_rows(metric, q, have)
                order = np.lexsort((np.arange(6000), own))[:10]
                assert ids.tolist() == order.tolist() and (d == own[order]).all()
            near = exact.Bounds(metric, have)
            low, gap = near.of(wanted)
            keys = pairwise(metric, wanted, have)[0] if metric != "l2" else np.stack([exact.exact_rows("l2", q, have) ** 2 for q in wanted])
            assert (low <= keys).all() and (keys <= low + gap(np.arange(len(wanted)))).all()
