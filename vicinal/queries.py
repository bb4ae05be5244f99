"""Registered queries of the vector engine, each with the SQL that gives the same rows.

The query vector is that of ``vec_id`` 0. Distances are rounded to six places, as the last
bits depend on the order of summation. Every ordered result carries its rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import METRICS, distance, vector
from vicinal.operators import AnnIndex, knn_join, near_join, nearest, range_search, with_distance
from vicinal.plans import sql
from vicinal.sources import scratch_path, table

K = 10


def base(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def first_vector(spark: SparkSession, folder: str) -> list[float]:
    row = base(spark, folder).filter("vec_id = 0").select("embedding").first()
    if row is None:
        raise ValueError(f"the embeddings of {folder} have no vec_id 0")
    return row[0]


def _rounded(name: str = "d") -> Column:
    return F.round(F.col(name), 6).alias(name)


def _ranked(df: DataFrame) -> DataFrame:
    """Number a result that is small by its limit, in the order that it has."""
    by = Window.orderBy(F.col("d").asc_nulls_last(), "vec_id")
    return df.select("vec_id", _rounded(), F.row_number().over(by).alias("rank"))


def _top(metric: str, offset: int = 0):
    def run(spark, folder):
        q = first_vector(spark, folder)
        found = nearest(base(spark, folder), "embedding", q, K, metric=metric, id_column="vec_id", offset=offset, name="d")
        return _ranked(found)

    return run


def _distances(metric: str):
    def run(spark, folder):
        return with_distance(base(spark, folder), "embedding", first_vector(spark, folder), metric, "d").select("vec_id", _rounded())

    return run


def knn_full_order(spark, folder):
    """Ranks of all rows without one task: ranges of distance are dealt out, then counted."""
    df = with_distance(base(spark, folder), "embedding", first_vector(spark, folder), "l2", "d").select("vec_id", "d")
    return global_rank(df)


def global_rank(df: DataFrame) -> DataFrame:
    """``vec_id, d, rank`` in the order of d, then vec_id, null last; buckets between quantiles of d are ranked side by side."""
    buckets = max(1, min(4096, df.count() // 10_000))
    cuts = df.approxQuantile("d", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucket = F.lit(0.0)
    if len(cuts) > 2:
        df, bucket = Bucketizer(splits=cuts, inputCol="d", outputCol="cut", handleInvalid="keep").transform(df), F.col("cut")
    placed = df.withColumn("bucket", F.when(F.col("d").isNull(), len(cuts)).otherwise(bucket).cast("int"))
    sizes = placed.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    by = Window.partitionBy("bucket").orderBy(F.col("d").asc_nulls_last(), "vec_id")
    ranked = placed.withColumn("own", F.row_number().over(by)).join(F.broadcast(starts), "bucket")
    return ranked.select("vec_id", _rounded(), (F.col("start") + F.col("own")).alias("rank"))


def knn_farthest(spark, folder):
    q = first_vector(spark, folder)
    found = nearest(base(spark, folder), "embedding", q, K, id_column="vec_id", descending=True, name="d")
    return found.select("vec_id", _rounded(), F.row_number().over(Window.orderBy(F.desc("d"), "vec_id")).alias("rank"))


def knn_commuted(spark, folder):
    q = vector(first_vector(spark, folder))
    df = base(spark, folder).select("vec_id", distance("l2", q, F.col("embedding")).alias("d"))
    return _ranked(df.orderBy("d", "vec_id").limit(K))


def _holed(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.when(F.col("vec_id") % 50 != 0, F.col("embedding")))


def knn_nulls_last(spark, folder):
    df = with_distance(_holed(base(spark, folder)), "embedding", first_vector(spark, folder), "l2", "d")
    return global_rank(df.select("vec_id", "d"))


def knn_nulls_excluded(spark, folder):
    """The index takes no null vectors."""
    q = first_vector(spark, folder)
    index = AnnIndex.build(_holed(base(spark, folder)), scratch_path(spark, "index"), id_column="vec_id", column="embedding", dims=64)
    return _found(index.search(q, ef=max(1, index._meta.rows)))


def count_all(spark, folder):
    return _holed(base(spark, folder)).agg(F.count("*").alias("n"))


def null_query(spark, folder):
    return with_distance(base(spark, folder), "embedding", None, "l2", "d").select("vec_id", "d")


def int_array_cast(spark, folder):
    q = F.array(*[F.lit(i % 3) for i in range(64)])
    return _ranked(base(spark, folder).select("vec_id", distance("l2", F.col("embedding"), q).alias("d")).orderBy("d", "vec_id").limit(K))


def flatten_vector(spark, folder):
    nested = F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    df = base(spark, folder).withColumn("embedding", nested)
    return with_distance(df, "embedding", first_vector(spark, folder), "l2", "d").select("vec_id", _rounded())


def zero_vector_cosine(spark, folder):
    d = distance("cosine", F.col("embedding"), vector([0.0] * 64))
    return base(spark, folder).select("vec_id", F.isnan(d).alias("undefined"))


def filtered_knn(spark, folder):
    q = first_vector(spark, folder)
    return _ranked(nearest(base(spark, folder).filter("label = 3"), "embedding", q, K, id_column="vec_id", name="d"))


def range_within(spark, folder):
    return range_search(base(spark, folder), "embedding", first_vector(spark, folder), 1.3, name="d").select("vec_id", _rounded())


def knn_join_all(spark, folder):
    df = base(spark, folder)
    found = knn_join(df, df.filter("vec_id % 20 = 0"), 5, base_id="vec_id", base_vector="embedding", query_id="vec_id", query_vector="embedding")
    return found.select("query_id", F.col("base_id").alias("vec_id"), _rounded("distance"), "rank")


def knn_per_label(spark, folder):
    by = Window.partitionBy("label").orderBy("d", "vec_id")
    df = with_distance(base(spark, folder), "embedding", first_vector(spark, folder), "l2", "d")
    return df.withColumn("rank", F.row_number().over(by)).filter("rank <= 3").select("label", "vec_id", _rounded(), "rank")


def _near_pairs(spark, folder, radius: float) -> DataFrame:
    """Stated queries (vec_id divisible by 20) against all rows."""
    df = base(spark, folder)
    found = near_join(df, df.filter("vec_id % 20 = 0"), radius, base_id="vec_id", base_vector="embedding", query_id="vec_id", query_vector="embedding")
    return found.withColumnRenamed("base_id", "vec_id")


def distance_theta_join(spark, folder):
    return _near_pairs(spark, folder, 1.2).filter("query_id <> vec_id").select("query_id", "vec_id", _rounded("distance"))


def semi_join_near(spark, folder):
    near = _near_pairs(spark, folder, 1.2).filter("query_id <> vec_id").select("vec_id").distinct()
    return base(spark, folder).join(near, "vec_id", "left_semi").select("vec_id", "label")


def anti_join_near(spark, folder):
    near = _near_pairs(spark, folder, 1.2).filter("query_id <> vec_id").select("vec_id").distinct()
    return base(spark, folder).join(near, "vec_id", "left_anti").select("vec_id", "label")


def distance_stats(spark, folder):
    df = with_distance(base(spark, folder), "embedding", first_vector(spark, folder), "l2", "d")
    return df.groupBy("label").agg(F.count("*").alias("n"), *[F.round(f("d"), 6).alias(n) for n, f in (("d_min", F.min), ("d_avg", F.avg), ("d_max", F.max))])


def infix_operators(spark, folder):
    """The SQL surface with its infix operators."""
    q = "array[" + ",".join(repr(x) for x in first_vector(spark, folder)) + "]"
    base(spark, folder).createOrReplaceTempView("vicinal_embeddings")
    return sql(
        spark,
        f"SELECT vec_id, round(double(embedding <-> {q}), 4) AS l2, round(double({q} <=> embedding), 4) AS cosine,"
        f" round(double(embedding <~> {q}), 3) AS manhattan FROM vicinal_embeddings",
    )


def _found(found: DataFrame) -> DataFrame:
    return found.select(F.col("row_id").alias("vec_id"), F.round("distance", 6).alias("d"), "rank")


def _index(spark, folder, metric="l2", rows=None, **options):
    df = base(spark, folder) if rows is None else rows
    return AnnIndex.build(df, scratch_path(spark, "index"), id_column="vec_id", column="embedding", dims=64, metric=metric, **options)


def _ann(metric: str):
    def run(spark, folder):
        index = _index(spark, folder, metric)
        return _found(index.search(first_vector(spark, folder), K, ef=index._meta.rows))

    return run


def ann_insert(spark, folder):
    df = base(spark, folder)
    index = _index(spark, folder, rows=df.filter("vec_id % 2 = 0"))
    index.insert(df.filter("vec_id % 2 = 1"), id_column="vec_id", column="embedding")
    return _found(index.search(first_vector(spark, folder), K, ef=index._meta.rows))


def ann_delete(spark, folder):
    index = _index(spark, folder)
    index.delete(base(spark, folder).filter("vec_id % 3 = 0"), "vec_id")
    return _found(index.search(first_vector(spark, folder), K, ef=index._meta.rows))


def ann_truncate(spark, folder):
    df = base(spark, folder)
    index = _index(spark, folder)
    index.truncate()
    index.insert(df.filter("vec_id % 2 = 1"), id_column="vec_id", column="embedding")
    return _found(index.search(first_vector(spark, folder), K, ef=index._meta.rows))


def ann_filtered(spark, folder):
    """The beam grows until the filter leaves enough rows."""
    index = _index(spark, folder)
    allowed = base(spark, folder).filter("label = 3").select(F.col("vec_id").alias("row_id"))
    return _found(index.search(first_vector(spark, folder), K, ef=index._meta.rows, allowed=allowed))


def ann_compact(spark, folder):
    index = _index(spark, folder)
    index.delete(base(spark, folder).filter("vec_id % 3 = 0"), "vec_id")
    index.compact()
    return _found(AnnIndex.load(spark, index.path).search(first_vector(spark, folder), K, ef=index._meta.rows))


def ann_default_options(spark, folder):
    return _found(_index(spark, folder).search(first_vector(spark, folder), K))


def _recall(index: AnnIndex, df: DataFrame, metric: str, allowed: DataFrame | None = None) -> DataFrame:
    """Recall at ten of the index at its default options, for all vec_id divisible by 20, against the exact join."""
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = index.search(asked, K, allowed=allowed).select("query_id", "row_id")
    among = df if allowed is None else df.join(allowed, df["vec_id"] == allowed["row_id"], "left_semi")
    best = knn_join(among, asked, K, metric=metric, base_id="vec_id", base_vector="embedding", query_id="query_id", query_vector="query")
    both = best.select("query_id", F.col("base_id").alias("row_id")).join(found.withColumn("hit", F.lit(1)), ["query_id", "row_id"], "left")
    return both.agg(F.lit(metric).alias("metric"), F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_best"), (F.count("hit") / F.count("*") >= 0.95).alias("recall_95"))


def ann_recall(spark, folder):
    """All three metrics at the default beam of 64."""
    df = base(spark, folder)
    found = [_recall(_index(spark, folder, metric), df, metric) for metric in METRICS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def ann_iterative_scan(spark, folder):
    """A filter that leaves a sixtieth of the rows: the beam of 16 has to double before ten of them are met."""
    df = base(spark, folder)
    index = _index(spark, folder, efsearch=16)
    return _recall(index, df, "l2", df.filter("vec_id % 60 = 7").select(F.col("vec_id").alias("row_id")))


def set_operations(spark, folder):
    """Rows near by L2 or by Manhattan distance, near by both, and near by the first alone."""
    q = first_vector(spark, folder)
    a, b = (with_distance(base(spark, folder), "embedding", q, m, "d").filter(F.col("d") < limit).select("vec_id") for m, limit in (("l2", 1.35), ("manhattan", 8.7)))
    named = lambda df, name: df.select(F.lit(name).alias("of"), "vec_id")
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "intersect")).unionByName(named(a.exceptAll(b), "except"))


def _by_label(spark, folder) -> DataFrame:
    df = with_distance(base(spark, folder), "embedding", first_vector(spark, folder), "l2", "d")
    return df.select("label", (F.col("d") < 1.4).alias("near"), "d")


def _grouped(df) -> DataFrame:
    sums = [F.count("*").alias("n"), F.round(F.min("d"), 6).alias("d_min"), F.round(F.max("d"), 6).alias("d_max")]
    return df.agg(F.grouping_id().cast("long").alias("level"), *sums)


def distance_rollup(spark, folder):
    return _grouped(_by_label(spark, folder).rollup("label", "near"))


def distance_cube(spark, folder):
    return _grouped(_by_label(spark, folder).cube("label", "near"))


def distance_distinct(spark, folder):
    return _by_label(spark, folder).select("label", "near").distinct()


def distance_sink(spark, folder):
    """Distances written as Parquet and read back."""
    path = scratch_path(spark, "distances")
    _distances("l2")(spark, folder).write.parquet(path)
    return spark.read.parquet(path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {f"{m}_distance": _distances(m) for m in METRICS}
    found |= {f"knn_{m}": _top(m) for m in METRICS} | {"knn_offset": _top("l2", offset=5)}
    found |= {f"ann_{m}": _ann(m) for m in METRICS}
    named = (
        knn_full_order, knn_farthest, knn_commuted, knn_nulls_last, knn_nulls_excluded, count_all, null_query, int_array_cast,
        flatten_vector, zero_vector_cosine, filtered_knn, knn_per_label, distance_theta_join, semi_join_near, anti_join_near,
        distance_stats, infix_operators, ann_insert, ann_delete, ann_truncate, ann_filtered, ann_compact, ann_default_options,
        ann_recall, ann_iterative_scan, set_operations, distance_rollup, distance_cube, distance_distinct, distance_sink,
    )
    return found | {f.__name__: f for f in named} | {"range_search": range_within, "knn_join": knn_join_all}


_E, _Q = "embedding::DOUBLE[]", "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _sql_distance(metric: str, a: str = _E, b: str = _Q) -> str:
    if metric == "manhattan":
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1] - x[2])))"
    return f"{'list_distance' if metric == 'l2' else 'list_cosine_distance'}({a}, {b})"


def _sql_top(metric: str = "l2", where: str = "true", limit: str = f"LIMIT {K}", a: str = _E, b: str = _Q, order: str = "d") -> str:
    inner = f"SELECT vec_id, {_sql_distance(metric, a, b)} AS d FROM embeddings WHERE {where} ORDER BY {order} NULLS LAST, vec_id {limit}"
    return f"SELECT vec_id, round(d, 6) AS d, row_number() OVER (ORDER BY {order} NULLS LAST, vec_id) AS rank FROM ({inner})"


def oracle_sql() -> dict[str, str]:
    found = {f"{m}_distance": f"SELECT vec_id, round({_sql_distance(m)}, 6) AS d FROM embeddings" for m in METRICS}
    found |= {f"{kind}_{m}": _sql_top(m) for m in METRICS for kind in ("knn", "ann")}
    holed = "CASE WHEN vec_id % 50 <> 0 THEN embedding END::DOUBLE[]"
    numbers = "[" + ",".join(f"{i % 3}.0" for i in range(64)) + "]::DOUBLE[]"
    pairs = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {_sql_distance('l2', 'e.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')} AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"
    near = f"SELECT vec_id FROM ({pairs}) WHERE distance < 1.2 AND query_id <> vec_id"
    found |= {
        "knn_offset": _sql_top(limit=f"LIMIT {K} OFFSET 5"),
        "knn_full_order": _sql_top(limit=""),
        "knn_farthest": _sql_top(order="d DESC"),
        "knn_commuted": _sql_top(a=_Q, b=_E),
        "knn_nulls_last": _sql_top(a=holed, limit=""),
        "knn_nulls_excluded": _sql_top(where="vec_id % 50 <> 0", limit=""),
        "count_all": "SELECT count(*) AS n FROM embeddings",
        "null_query": "SELECT vec_id, CAST(NULL AS DOUBLE) AS d FROM embeddings",
        "int_array_cast": _sql_top(b=numbers),
        "flatten_vector": f"SELECT vec_id, round({_sql_distance('l2')}, 6) AS d FROM embeddings",
        "zero_vector_cosine": "SELECT vec_id, true AS undefined FROM embeddings",
        "filtered_knn": _sql_top(where="label = 3"),
        "range_search": f"SELECT vec_id, round(d, 6) AS d FROM (SELECT vec_id, {_sql_distance('l2')} AS d FROM embeddings) WHERE d < 1.3",
        "knn_join": f"SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM ({pairs})) WHERE rank <= 5",
        "knn_per_label": f"SELECT label, vec_id, round(d, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM (SELECT label, vec_id, {_sql_distance('l2')} AS d FROM embeddings)) WHERE rank <= 3",
        "distance_theta_join": f"SELECT query_id, vec_id, round(distance, 6) AS distance FROM ({pairs}) WHERE distance < 1.2 AND query_id <> vec_id",
        "semi_join_near": f"SELECT vec_id, label FROM embeddings WHERE vec_id IN ({near})",
        "anti_join_near": f"SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN ({near})",
        "distance_stats": f"SELECT label, count(*) AS n, round(min(d), 6) AS d_min, round(avg(d), 6) AS d_avg, round(max(d), 6) AS d_max FROM (SELECT label, {_sql_distance('l2')} AS d FROM embeddings) GROUP BY label",
        "infix_operators": f"SELECT vec_id, round({_sql_distance('l2')}::FLOAT::DOUBLE, 4) AS l2, round({_sql_distance('cosine')}::FLOAT::DOUBLE, 4) AS cosine, round(({_sql_distance('manhattan')})::FLOAT::DOUBLE, 3) AS manhattan FROM embeddings",
        "ann_insert": _sql_top(),
        "ann_delete": _sql_top(where="vec_id % 3 <> 0"),
        "ann_truncate": _sql_top(where="vec_id % 2 = 1"),
        "ann_filtered": _sql_top(where="label = 3"),
        "ann_compact": _sql_top(where="vec_id % 3 <> 0"),
    }
    by_label = f"SELECT label, d < 1.4 AS near, d FROM (SELECT label, {_sql_distance('l2')} AS d FROM embeddings)"
    sums = "count(*) AS n, round(min(d), 6) AS d_min, round(max(d), 6) AS d_max"
    levels = "label, near, grouping(label) * 2 + grouping(near) AS level"
    met = {m: f"SELECT vec_id FROM (SELECT vec_id, {_sql_distance(m)} AS d FROM embeddings) WHERE d < {limit}" for m, limit in (("l2", 1.35), ("manhattan", 8.7))}
    asked = "(SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0)"
    recall = lambda m, rows: f"SELECT '{m}' AS metric, {asked} AS n_queries, {asked} * least({K}, ({rows})) AS n_best, true AS recall_95"
    found |= {
        "ann_recall": " UNION ALL ".join(recall(m, "SELECT count(*) FROM embeddings") for m in METRICS),
        "ann_iterative_scan": recall("l2", "SELECT count(*) FROM embeddings WHERE vec_id % 60 = 7"),
        "set_operations": f"SELECT 'union' AS of, vec_id FROM ({met['l2']} UNION {met['manhattan']}) UNION ALL SELECT 'intersect', vec_id FROM ({met['l2']} INTERSECT {met['manhattan']}) UNION ALL SELECT 'except', vec_id FROM ({met['l2']} EXCEPT ALL {met['manhattan']})",
        "distance_rollup": f"SELECT {levels}, {sums} FROM ({by_label}) GROUP BY ROLLUP (label, near)",
        "distance_cube": f"SELECT {levels}, {sums} FROM ({by_label}) GROUP BY CUBE (label, near)",
        "distance_distinct": f"SELECT DISTINCT label, near FROM ({by_label})",
        "distance_sink": found["l2_distance"],
    }
    return found
