"""The registered queries: each operator on the whole test tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.aggregates import Avg, Count, Max, Median, Min, SlicedAggregation, Sum
from .functions.predicates import And, Eq, Gt, In, Like, Not, Or, Ref
from .model import Database, Relation, Relationship, Tensor
from .operators.constraints import InSubset, MaxCount, SameAttributes, Schema, add_join_predicate, add_reference, delete, drop_join_predicate, drop_reference, insert, update
from .operators.filters import filter_items, filter_items_scan_complement, filter_keys, filter_values
from .operators.grouping import above_average, aggregate, cube, group_by, group_by_aggregate, partition, partition_by_aggregate
from .operators.joins import cogroup, join, partner_counts, reference_blockers, reference_violations, semijoin, subdatabase
from .operators.ranking import items_sorted_by, rank_by, subset
from .operators.sets import intersect, minus, union, values_union
from .operators.shapes import disaggregate, flatten, project, rename, transform, transform_items
from .plans.ir import LogicalPlan, extract
from .sources import catalog
from .sources.sales import database
from .streaming.events import deduplicated, sessions, windowed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _money(column: Column) -> Column:
    """Sums of doubles depend on the order of addition in the last digits."""
    return F.round(column, 2)


@_query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE c_mktsegment = 'BUILDING' GROUP BY n_name""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    db = db.with_relations({**db.relations, "customer": db["customer"].where(Eq("c_mktsegment", "BUILDING"))})
    rows = join(db)
    revenue = lambda row: F.sum(row.lineitem.l_extendedprice * (1 - row.lineitem.l_discount))
    return group_by_aggregate(rows, "nation.n_name", revenue=lambda row: _money(revenue(row)), lines=Count()).result.df


@_query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def filter_values_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_values(database(spark, sf_dir, "customer")["customer"], And(Eq("c_mktsegment", "BUILDING"), Gt("c_acctbal", 5000)))
    return project(rows, "c_name", "c_acctbal").result.df


@_query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000")
def filter_items_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer")["customer"].where(lambda item: (item.value.c_mktsegment == "BUILDING") & (item.value.c_acctbal > 9000))
    return rows.df.select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)")
def filter_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_items_scan_complement(database(spark, sf_dir, "customer")["customer"], Eq("c_mktsegment", "BUILDING")).result.df.select("c_custkey")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def filter_keys_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_keys(database(spark, sf_dir, "orders")["orders"], lambda key: (key >= 100) & (key <= 199)).result.df.select("o_orderkey", "o_custkey")


@_query("""
SELECT c_custkey, c_name, c_nationkey FROM customer
WHERE c_acctbal >= 0 AND c_acctbal <= 9000 AND c_nationkey IN (1, 2, 3, 4, 5, 6) AND contains(lower(c_name), 'customer#00000') AND suffix(c_mktsegment, 'G')""")
def where_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer")["customer"].where(
        c_acctbal__gte=0, c_acctbal__lte=9000, c_nationkey__in=[1, 2, 3, 4, 5, 6], c_name__icontains="CUSTOMER#00000", c_mktsegment__endswith="G"
    )
    return rows.df.select("c_custkey", "c_name", "c_nationkey")


@_query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 100 AND c_name IS NOT NULL")
def where_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "customer")["customer"].where(c_acctbal__range=(0, 100), c_name__isnull=False).df.select("c_custkey")


@_query("""
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') UNION ALL SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')
UNION ALL SELECT p_partkey, p_name FROM part WHERE suffix(p_name, 'ring') UNION ALL SELECT p_partkey, p_name FROM part WHERE p_name = 'red widget'""")
def like_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = database(spark, sf_dir, "part")["part"]
    found = [filter_values(part, Like("p_name", p)).result.df.select("p_partkey", "p_name") for p in ("%ring%", "red%", "%ring", "red widget")]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@_query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount > l_tax GROUP BY l_returnflag")
def predicate_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_values(database(spark, sf_dir, "lineitem")["lineitem"], Gt("l_discount", Ref("l_tax")))
    return group_by_aggregate(rows, "l_returnflag", n=Count()).result.df


@_query("""
SELECT p_partkey FROM part WHERE (p_brand = 'Brand#2' OR starts_with(p_name, 'red')) AND p_size NOT IN (1, 2, 3)""")
def predicate_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_values(database(spark, sf_dir, "part")["part"], And(Or(Eq("p_brand", "Brand#2"), Like("p_name", "red%")), Not(In("p_size", [1, 2, 3]))))
    return rows.result.df.select("p_partkey")


@_query("""
SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders", "customer", "nation")
    return filter_values(db["orders"], Eq("customer.nation.n_name", "NATION_3")).result.df.select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def project_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "orders", "customer")["orders"].project("o_totalprice", "customer__c_name", "absent").df


@_query("SELECT n_nationkey, n_name AS nation_name, n_regionkey FROM nation")
def rename_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename(database(spark, sf_dir, "nation")["nation"], n_name="nation_name", absent="x").result.df


@_query("""
SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_suppkey""")
def computed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = database(spark, sf_dir, "lineitem")["lineitem"]
    lines = lines.with_computed(price=lambda v: v.l_extendedprice * (1 - v.l_discount), charge=lambda v: v.price * (1 + v.l_tax))
    return group_by_aggregate(lines, "l_suppkey", charge=lambda v: _money(F.sum(v.charge))).result.df


@_query("SELECT n_nationkey, lower(n_name) AS name FROM nation WHERE n_regionkey <> 0")
def transform_items_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_items(database(spark, sf_dir, "nation")["nation"], columns={"name": lambda v: F.lower(v.n_name)}, keep=lambda v: v.n_regionkey != 0).result.df


@_query("SELECT n_regionkey AS k, max_by(n_name, n_nationkey) AS name FROM nation GROUP BY n_regionkey")
def transform_items_rekeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform_items(database(spark, sf_dir, "nation")["nation"], columns={"k": lambda v: v.n_regionkey, "name": lambda v: v.n_name}, key=("k",)).result.df


@_query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def semijoin_target_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = semijoin(database(spark, sf_dir, "orders", "lineitem"), reduce="orders", by="lineitem", ref_key="order").result
    return db["orders"].df.select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def semijoin_source_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders", "customer")
    db = db.with_relations({**db.relations, "customer": db["customer"].where(c_nationkey=3)})
    return semijoin(db, reduce="orders", by="customer", ref_key="customer").result["orders"].df.select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = semijoin(database(spark, sf_dir, "orders", "lineitem"), reduce="orders", by="lineitem", ref_key="order", anti=True).result
    return db["orders"].df.select("o_orderkey")


def _asia_pending(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark, sf_dir, "region", "nation", "customer", "orders")
    return db.with_relations({**db.relations, "region": db["region"].where(r_name="ASIA"), "orders": db["orders"].where(o_orderstatus="P")})


_ASIA = "FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA' AND o_orderstatus = 'P'"


@_query(f"""
SELECT DISTINCT 'region' AS relation, CAST(r_regionkey AS BIGINT) AS k {_ASIA} UNION ALL SELECT DISTINCT 'nation', CAST(n_nationkey AS BIGINT) {_ASIA}
UNION ALL SELECT DISTINCT 'customer', c_custkey {_ASIA} UNION ALL SELECT DISTINCT 'orders', o_orderkey {_ASIA}""")
def subdatabase_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(subdatabase(_asia_pending(spark, sf_dir)).result)


def _keys(db: Database) -> DataFrame:
    frames = [r.df.select(F.lit(n).alias("relation"), F.col(r.key[0]).cast("long").alias("k")) for n, r in db.bound().items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


@_query(f"SELECT DISTINCT c_custkey, c_name, c_acctbal {_ASIA}")
def subdatabase_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subdatabase(_asia_pending(spark, sf_dir), strategy="cascade").result["customer"].df.select("c_custkey", "c_name", "c_acctbal")


_DIAMOND = """FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey
WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 5000 AND o_orderstatus = 'P'"""


def _diamond(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark, sf_dir, "nation", "customer", "supplier", "orders", "lineitem")
    changed = {"customer": db["customer"].where(c_mktsegment="BUILDING"), "supplier": db["supplier"].where(s_acctbal__gt=5000), "orders": db["orders"].where(o_orderstatus="P")}
    return db.with_relations({**db.relations, **changed})


@_query(f"""
SELECT DISTINCT 'nation' AS relation, CAST(n_nationkey AS BIGINT) AS k {_DIAMOND} UNION ALL SELECT DISTINCT 'customer', c_custkey {_DIAMOND}
UNION ALL SELECT DISTINCT 'supplier', s_suppkey {_DIAMOND} UNION ALL SELECT DISTINCT 'orders', o_orderkey {_DIAMOND}""")
def subdatabase_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _diamond(spark, sf_dir)
    lines = db.relations["lineitem"]
    # Lines have no key; here the columns that link them stand in.
    db = db.with_relations({**db.relations, "lineitem": lines.index_by("l_orderkey", "l_suppkey")})
    found = subdatabase(db).result
    return _keys(found.subset("nation", "customer", "supplier", "orders"))


@_query("""
WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P')
SELECT 'customer' AS relation, c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey)
UNION ALL SELECT 'orders', o_orderkey FROM o""")
def subdatabase_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "orders")
    db = db.with_relations({**db.relations, "orders": db["orders"].where(o_orderstatus="P")})
    return _keys(subdatabase(db, anti=("customer",)).result)


@_query("""
SELECT o_orderkey AS "orders.o_orderkey", c_custkey AS "customer.c_custkey", c_name AS "orders.customer.c_name", n_name AS "nation.n_name", n_name AS "orders.customer.nation.n_name"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def join_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flatten(join(database(spark, sf_dir, "orders", "customer", "nation"))).result.df
    names = ["orders.o_orderkey", "customer.c_custkey", "orders.customer.c_name", "nation.n_name", "orders.customer.nation.n_name"]
    return rows.select(*[F.col(f"`{n}`") for n in names])


@_query("""
SELECT p_brand, count(*) AS lines, round(sum(l_quantity), 2) AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE s_acctbal > 0 AND o_orderstatus = 'O' GROUP BY p_brand""")
def join_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders", "part", "supplier", "lineitem")
    db = db.with_relations({**db.relations, "supplier": db["supplier"].where(s_acctbal__gt=0), "orders": db["orders"].where(o_orderstatus="O")})
    return group_by_aggregate(join(db), "part.p_brand", lines=Count(), quantity=lambda r: _money(F.sum(r.lineitem.l_quantity))).result.df


@_query("""
SELECT c_custkey, s_suppkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey
WHERE c_acctbal > 9500 AND s_acctbal > 5000""")
def join_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "nation", "supplier")
    db = db.with_relations({**db.relations, "customer": db["customer"].where(c_acctbal__gt=9500), "supplier": db["supplier"].where(s_acctbal__gt=5000)})
    return join(db).result.df.select("customer.c_custkey", "supplier.s_suppkey", "nation.n_name")


@_query(f"SELECT n_name, count(*) AS lines {_DIAMOND} GROUP BY n_name")
def join_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by_aggregate(join(_diamond(spark, sf_dir)), "nation.n_name", lines=Count()).result.df


@_query("SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def join_labels_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "documents", "labels")
    return group_by_aggregate(join(db), "documents.lang", n=Count(), toxic=Sum("labels.toxic")).result.df


@_query("""
SELECT s_suppkey, count(*) AS richer FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal GROUP BY s_suppkey""")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "supplier", "customer")
    same = add_join_predicate(db, "supplier", "customer", equal=(lambda s: s.s_nationkey, lambda c: c.c_nationkey), description="same nation")
    less = add_join_predicate(same, "customer", "supplier", above=(lambda c: c.c_acctbal, lambda s: s.s_acctbal))
    return partner_counts(less, "supplier", "customer", name="richer").result.df


@_query("""
SELECT coalesce(c.k, s.k) AS c_nationkey, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k""")
def cogroup_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "supplier")
    db = db.with_relations({"customer": db["customer"].where(c_acctbal__gt=9000), "supplier": db["supplier"].where(s_acctbal__gt=5000)})
    counts = {"customer": {"n": Count()}, "supplier": {"n": Count()}}
    groups = cogroup(db, {"customer": "c_nationkey", "supplier": "s_nationkey"}, aggregates=counts).result.df
    size = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return groups.select("c_nationkey", size("customer__n").alias("customers"), size("supplier__n").alias("suppliers"))


@_query("""
SELECT o_orderkey, o_orderstatus = 'O' AS is_open, o_totalprice > 250000 AS is_large FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 250000""")
def cogroup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = database(spark, sf_dir, "orders")["orders"]
    groups = cogroup(Database({"open": orders.where(o_orderstatus="O"), "large": orders.where(o_totalprice__gt=250000)})).result.df
    return groups.select("o_orderkey", F.col("open").isNotNull().alias("is_open"), F.col("large").isNotNull().alias("is_large"))


@_query("""
SELECT CAST(min(p_size) AS BIGINT) AS lo, CAST(max(p_size) AS BIGINT) AS hi, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean, median(p_size) AS med FROM part""")
def aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = aggregate(database(spark, sf_dir, "part")["part"], lo=Min("p_size"), hi=Max("p_size"), n=Count("p_size"), total=Sum("p_size"), mean=Avg("p_size"), med=Median("p_size")).result.df
    return df.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "n", "total", F.round("mean", 6).alias("mean"), "med")


@_query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n, median(l_quantity) AS middle
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def group_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group_by_aggregate(database(spark, sf_dir, "lineitem")["lineitem"], "l_returnflag", "l_linestatus", quantity=Sum("l_quantity"), discount=Avg("l_discount"), n=Count(), middle=Median("l_quantity")).result.df
    return rows.withColumns({"quantity": _money(F.col("quantity")), "discount": F.round("discount", 6)})


@_query("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def group_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = group_by_aggregate(database(spark, sf_dir, "orders", "customer", "nation")["orders"], "customer.nation.n_name", orders=Count(), total=Sum("o_totalprice")).result.df
    return rows.withColumn("total", _money(F.col("total")))


@_query("""
SELECT CASE WHEN o_totalprice > 200000 THEN 'high' ELSE 'low' END AS partition, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def partition_by_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = database(spark, sf_dir, "orders")["orders"]
    return partition_by_aggregate(orders, partitioning_function=lambda i: F.when(i.value.o_totalprice > 200000, "high").otherwise("low"), n=Count(), most=Max("o_totalprice")).result.df


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def group_by_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by(database(spark, sf_dir, "orders")["orders"], "o_orderpriority").result["1-URGENT"].df.select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3")
def partition_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition(database(spark, sf_dir, "orders")["orders"], partitioning_function=lambda i: i.key % 7).result[3].df.select("o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, p_name, p_retailprice FROM part")
def rank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_by(database(spark, sf_dir, "part")["part"], ranking_key="p_retailprice", reverse=True).result.df.select("rank", "p_name", "p_retailprice")


@_query("""
SELECT rank, o_totalprice FROM (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, o_totalprice FROM orders) WHERE rank BETWEEN 100 AND 119""")
def rank_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_by(database(spark, sf_dir, "orders")["orders"], ranking_key=lambda i: i.value.o_totalprice)
    return filter_keys(ranks, lambda rank: (rank >= 100) & (rank <= 119)).result.df.select("rank", "o_totalprice")


@_query("""
SELECT c_nationkey, rank, c_acctbal FROM
(SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank, c_acctbal FROM customer) WHERE rank < 3""")
def rank_within_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = rank_by(database(spark, sf_dir, "customer")["customer"], ranking_key="c_acctbal", reverse=True, partition_by=("c_nationkey",)).result
    return ranks.where(rank__lt=3).df.select("c_nationkey", "rank", "c_acctbal")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset(database(spark, sf_dir, "orders")["orders"], ranking_key="o_totalprice", k=10, reverse=True).result.df.select("o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def subset_above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subset(database(spark, sf_dir, "orders")["orders"], subset_predicate=above_average("o_totalprice")).result.df.select("o_orderkey")


def _two_sets(spark: SparkSession, sf_dir: str) -> Database:
    orders = database(spark, sf_dir, "orders")["orders"]
    tagged = lambda r, tag: r.with_df(r.df.select("o_orderkey", F.lit(tag).alias("tag")))
    return Database({"open": tagged(orders.where(o_orderstatus="O"), "open"), "large": tagged(orders.where(o_totalprice__gt=250000), "large")})


@_query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'large' ELSE 'open' END AS tag FROM orders WHERE o_orderstatus = 'O' OR o_totalprice > 250000""")
def union_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union(_two_sets(spark, sf_dir)).result.df


@_query("SELECT o_orderkey, 'open' AS tag FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000")
def intersect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersect(_two_sets(spark, sf_dir)).result.df


@_query("SELECT o_orderkey, 'open' AS tag FROM orders WHERE o_orderstatus = 'O' AND NOT o_totalprice > 250000")
def minus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minus(_two_sets(spark, sf_dir)).result.df


@_query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "supplier")
    named = {"c": db["customer"].df.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation")), "s": db["supplier"].df.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))}
    return values_union(Database({n: Relation(df, ("k",)) for n, df in named.items()})).result.df


@_query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def cube_as_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = cube(database(spark, sf_dir, "orders")["orders"], "o_orderpriority", "o_orderstatus", n=Count()).result
    frames = [db[name].df for name in db]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@_query("SELECT count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders", "customer")
    db = drop_reference(db, source="orders", ref_key="customer", target="customer").result
    db = db.with_relations({**db.relations, "customer": db["customer"].where(c_acctbal__gt=0)})
    db = add_reference(db, source="orders", ref_key="buyer", target="customer", columns="o_custkey").result
    return aggregate(Relation(reference_violations(db, db.references[0]), ("o_orderkey",)), violations=Count()).result.df


@_query("SELECT n_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY n_nationkey")
def delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "nation", "customer")
    found = reference_blockers(db, db.references[0], db["nation"].where(n_regionkey=1).df)
    return found.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))


@_query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 7")
def related_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = database(spark, sf_dir, "lineitem")["lineitem"].df
    return Relationship(lines, ("l_suppkey", "l_partkey"), parts=("supplier", "part")).related_values(0, 7, 1).distinct()


@_query("""
SELECT CAST(d.k AS INTEGER) AS n_nationkey, coalesce(n_name, 'nation ' || d.k) AS n_name FROM range(40) d(k) LEFT JOIN nation ON n_nationkey = d.k""")
def default_over_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = database(spark, sf_dir, "nation")["nation"].project("n_name")
    domain = spark.range(40).select(F.col("id").cast("int").alias("n_nationkey"))
    return nation.with_default({"n_name": lambda k: F.concat(F.lit("nation "), k.cast("string"))}, domain).items()


def _tensor(spark: SparkSession, sf_dir: str) -> Tensor:
    vectors = database(spark, sf_dir, "embeddings")["embeddings"].df
    cells = vectors.select(F.col("vec_id").alias("c0"), F.posexplode("embedding").alias("c1", "value")).select("c0", F.col("c1").cast("long").alias("c1"), F.col("value").cast("double").alias("value"))
    return Tensor(cells, (1 << 40, 64))


_CELLS = "(SELECT vec_id AS c0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c1, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@_query(f"SELECT c1, round(sum(value + value), 4) AS total FROM {_CELLS} GROUP BY c1")
def tensor_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tensor(spark, sf_dir)
    return (t + t).df.groupBy("c1").agg(F.round(F.sum("value"), 4).alias("total"))


@_query(f"SELECT c1, round(sum(value * value), 4) AS total FROM {_CELLS} GROUP BY c1")
def tensor_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tensor(spark, sf_dir)
    return (t * t).df.groupBy("c1").agg(F.round(F.sum("value"), 4).alias("total"))


@_query(f"WITH t AS {_CELLS} SELECT a.c1 AS c0, b.c1, round(sum(a.value * b.value), 4) AS value FROM t a JOIN t b ON a.c0 = b.c0 GROUP BY 1, 2")
def tensor_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tensor(spark, sf_dir)
    turned = Tensor(t.df.select(F.col("c1").alias("c0"), F.col("c0").alias("c1"), "value"), t.dimensions[::-1])
    return (turned @ t).df.withColumn("value", F.round("value", 4))


@_query("""
SELECT min(p_name) AS first_part, min(s_name) AS first_supplier, count(*) AS lines FROM lineitem
JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_name LIKE '%ring%' AND s_acctbal > 0 AND p_size BETWEEN 5 AND 20""")
def min_over_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "part", "supplier", "lineitem")
    db = db.with_relations({**db.relations, "part": db["part"].where(p_name__like="%ring%", p_size__range=(5, 20)), "supplier": db["supplier"].where(s_acctbal__gt=0)})
    return aggregate(join(db), first_part=Min("part__p_name"), first_supplier=Min("supplier.s_name"), lines=Count()).result.df


@_query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place, unnest(embedding) AS embedding FROM embeddings")
def disaggregate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disaggregate(database(spark, sf_dir, "embeddings")["embeddings"].project("embedding"), "embedding").result.df


@_query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = database(spark, sf_dir, "events")["events"].df
    return windowed(events, ["event_type"], {"n": F.count(F.lit(1)), "total": _money(F.sum("value"))}).drop("window_end")


@_query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = database(spark, sf_dir, "events")["events"].df
    return sessions(events, ["user_id"], {"n": F.count(F.lit(1))}).drop("session_end")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(database(spark, sf_dir, "events")["events"].df.select("user_id", "event_type", "ts"), ["user_id", "event_type"]).select("user_id", "event_type")


@_query("""
SELECT c_name, count(*) AS n, round(sum(value) , 2) AS total FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase' GROUP BY c_name""")
def events_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "events", "customer")
    return group_by_aggregate(db["events"].where(event_type="purchase"), "user.c_name", n=Count(), total=lambda v: _money(F.sum(v.value))).result.df


@_query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, max(turn) AS last_turn FROM conversations GROUP BY role")
def conversation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "conversations")["conversations"]
    return group_by_aggregate(rows, "role", n=Count(), conversations=lambda v: F.count_distinct(v.conv_id), last_turn=Max("turn")).result.df


@_query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicate goes through the plan's JSON before it is applied."""
    customer = database(spark, sf_dir, "customer")["customer"]
    plan = extract(filter_values(customer, And(Gt("c_acctbal", 1000), In("c_mktsegment", ["BUILDING", "MACHINERY"])))).to_json()
    predicate = LogicalPlan.from_json(plan).root.params["filter_predicate"]
    return group_by_aggregate(filter_values(customer, predicate), "c_mktsegment", n=Count()).result.df


@_query("""
SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r <= 5""")
def smallest_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "customer")["customer"].top(5, lambda i: i.value.c_acctbal).df.select("c_custkey", "c_acctbal")


@_query("SELECT user_id, event_id, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return database(spark, sf_dir, "events")["events"].df.select("user_id", "event_id", "value", F.round(F.sum("value").over(window), 4).alias("running"))


@_query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '00007') AND starts_with(c_mktsegment, 'B') AND NOT (c_acctbal IS NULL)")
def where_contains_startswith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer")["customer"]
    return rows.where(c_name__contains="00007", c_mktsegment__startswith="B", c_acctbal__isnull=False).df.select("c_custkey", "c_name")


@_query("SELECT doc_id, lang FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
def where_contains_in_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = database(spark, sf_dir, "documents")["documents"]
    words = transform_items(docs, columns={"lang": lambda v: v.lang, "words": lambda v: F.split(v.text, " ")}).result
    return words.where(words__contains="the").df.select("doc_id", "lang")


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL")
def where_isnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = cogroup(database(spark, sf_dir, "documents", "labels")).result
    return groups.where(labels__isnull=True, documents__isnull=False).df.select("doc_id")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 = 3 AND c_name LIKE '%3'")
def filter_items_by_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer")["customer"]
    return filter_items(rows, lambda item: item.key % 7 == 3 and item.value.c_name[-1] == "3", as_udf=True).result.df.select("c_custkey", "c_acctbal")


@_query("SELECT 'orders' AS relation, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def filter_database_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of a database that hold more than the customers."""
    db = database(spark, sf_dir, "nation", "customer", "orders", "lineitem")
    customers = len(db["customer"])
    kept = filter_values(db, lambda relation: len(relation) > customers).result
    return _each(kept, lambda df: df.agg(F.count(F.lit(1)).alias("n")))


def _each(db: Database, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    frames = [query(r.df).select(F.lit(n).cast("string").alias("relation"), "*") for n, r in db.relations.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@_query("""
SELECT '0' AS relation, count(*) AS n FROM region UNION ALL SELECT '1', count(*) FROM nation
UNION ALL SELECT '2', count(*) FROM customer UNION ALL SELECT '3', count(*) FROM orders""")
def rank_relations_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank_by(database(spark, sf_dir, "orders", "nation", "region", "customer"), ranking_key=len).result
    return _each(ranked, lambda df: df.agg(F.count(F.lit(1)).alias("n")))


@_query("SELECT 'orders' AS relation, CAST(sum(o_totalprice > 1000) AS BIGINT) AS n FROM orders")
def largest_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = subset(database(spark, sf_dir, "customer", "orders", "nation"), ranking_key=len, k=1, reverse=True).result
    return _each(kept, lambda df: df.agg(F.sum((F.col("o_totalprice") > 1000).cast("long")).alias("n")))


@_query("""
SELECT o_orderstatus, o_orderkey, rank FROM (
  SELECT o_orderstatus, o_orderkey, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey) - 1 AS rank FROM orders)""")
def rank_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three values for all rows: the ranges are cut inside the ties."""
    ranked = rank_by(database(spark, sf_dir, "orders")["orders"], ranking_key="o_orderstatus", reverse=True, keep_key=True).result
    return ranked.df.select("o_orderstatus", "o_orderkey", "rank")


@_query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def bottom_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir, "part")["part"].bottom(15, "p_retailprice").df.select("p_partkey", "p_retailprice")


@_query("SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_name DESC) - 1 AS place FROM region")
def regions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items_sorted_by(database(spark, sf_dir, "region")["region"], sorting_key="r_name", reverse=True).result
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"], i) for i, r in enumerate(rows)], "r_regionkey long, r_name string, place long")


@_query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey IN (1, 77, 150)")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer")["customer"]
    found = [(k, rows[k]["c_name"], rows(k)["c_nationkey"]) for k in (1, 77, 150) if k in rows]
    return spark.createDataFrame(found, "c_custkey long, c_name string, c_nationkey long")


@_query("SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag")
def aggregate_by_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = lambda values: (min(values), max(values))
    both = lambda parts: (min(lo for lo, _ in parts), max(hi for _, hi in parts))
    spread = SlicedAggregation(ends, "l_quantity", "double", merge=both, finish=lambda ends: float(ends[1] - ends[0]))
    return group_by_aggregate(database(spark, sf_dir, "lineitem")["lineitem"], "l_returnflag", spread=spread).result.df


@_query("SELECT 'customer' AS relation, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def aggregate_each_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(aggregate(database(spark, sf_dir, "customer", "supplier", "part"), n=Count()).result, lambda df: df)


@_query("""
SELECT 'l_returnflag/l_linestatus' AS relation, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL
UNION ALL SELECT 'l_returnflag', l_returnflag, NULL, count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'all', NULL, NULL, count(*) FROM lineitem""")
def rollup_as_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = cube(database(spark, sf_dir, "lineitem")["lineitem"], "l_returnflag", "l_linestatus", how="rollup", n=Count()).result
    keys = [F.col(k) for k in ("l_returnflag", "l_linestatus")]
    full = lambda df: df.select(*[k if c in df.columns else F.lit(None).cast("string").alias(c) for k, c in zip(keys, ("l_returnflag", "l_linestatus"), strict=True)], "n")
    return _each(db, full)


@_query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "region", "nation")
    loose = drop_reference(db, source="nation", ref_key="region", target="region").result
    rows = flatten(join(loose, cross=True)).result.df
    return rows.select(F.col("`region.r_name`").alias("r_name"), F.col("`nation.n_name`").alias("n_name"))


@_query("""
SELECT a.c_custkey AS richer, b.c_custkey AS poorer FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_acctbal > b.c_acctbal + 9000""")
def self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = database(spark, sf_dir, "customer")["customer"]
    db = Database({"a": customer, "b": customer.copy()})
    db = add_join_predicate(db, "a", "b", equal=(lambda a: a.c_nationkey, lambda b: b.c_nationkey)).result
    db = add_join_predicate(db, "a", "b", above=(lambda a: a.c_acctbal, lambda b: b.c_acctbal + 9000)).result
    return join(db).result.df.select(F.col("a.c_custkey").alias("richer"), F.col("b.c_custkey").alias("poorer"))


@_query("SELECT s_suppkey, count(*) AS same FROM supplier JOIN customer ON s_nationkey = c_nationkey GROUP BY s_suppkey")
def dropped_join_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "supplier", "customer")
    same = add_join_predicate(db, "supplier", "customer", equal=(lambda s: s.s_nationkey, lambda c: c.c_nationkey), description="same nation")
    less = add_join_predicate(same, "customer", "supplier", above=(lambda c: c.c_acctbal, lambda s: s.s_acctbal), description="richer")
    return partner_counts(drop_join_predicate(less, description="richer"), "supplier", "customer", name="same").result.df


@_query("""
WITH n AS (SELECT * FROM nation WHERE n_regionkey = 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n))
SELECT 'region' AS relation, r_regionkey AS key FROM region WHERE r_regionkey IN (0, 1, 2, 3, 4)
UNION ALL SELECT 'nation', n_nationkey FROM n WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'customer', c_custkey FROM c""")
def subdatabase_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are left whole and reduce nothing."""
    db = database(spark, sf_dir, "region", "nation", "customer")
    db = db.with_relations({**db.relations, "nation": db["nation"].where(n_regionkey=2)})
    small = subdatabase(db, keep=("region",)).result
    return _each(small, lambda df: df.select(F.col(df.columns[0]).cast("long").alias("key")))


@_query("SELECT o_orderkey, count(l_linenumber) AS lines FROM (SELECT * FROM orders WHERE o_orderkey < 500) LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def cogroup_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines have no key of their own, so a group is a list of them."""
    db = database(spark, sf_dir, "orders", "lineitem")
    db = Database({"orders": db["orders"].where(o_orderkey__lt=500), "lineitem": db["lineitem"].where(l_orderkey__lt=500)})
    groups = cogroup(db, {"orders": "o_orderkey", "lineitem": "l_orderkey"}).result
    return groups.df.where("orders IS NOT NULL").select("o_orderkey", F.coalesce(F.size("lineitem"), F.lit(0)).cast("long").alias("lines"))


@_query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 10 = 0""")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys are added, rows of known keys replaced; types, values and references are checked."""
    db = database(spark, sf_dir, "nation", "customer")
    rows = db["customer"].df.where("c_custkey % 10 = 0")
    checked = db["customer"].with_constraint(InSubset("c_mktsegment", tuple(r[0] for r in rows.select("c_mktsegment").distinct().collect())), MaxCount(10**9), SameAttributes(frozenset(rows.columns) - {"c_custkey"}))
    db = db.with_relations({**db.relations, "customer": checked})
    db = insert(db, "customer", rows.withColumn("c_acctbal", F.lit(0.0)))
    db = insert(db, "customer", rows.withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return db["customer"].df.select("c_custkey", "c_name", "c_acctbal")


@_query("""
SELECT n_nationkey, n_name, n_regionkey AS boss FROM nation
UNION ALL SELECT n_nationkey + 100, n_name, n_nationkey FROM nation UNION ALL SELECT n_nationkey + 200, n_name, n_nationkey + 100 FROM nation""")
def insert_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows refer to old rows, or to rows that come with them, of their own relation."""
    nation = database(spark, sf_dir, "nation")["nation"].df.select("n_nationkey", "n_name", F.col("n_regionkey").alias("boss"))
    db = add_reference(Database({"nation": Relation(nation, ("n_nationkey",))}), source="nation", ref_key="leader", target="nation", columns="boss", validate=True).result
    moved = lambda by, boss: nation.select((F.col("n_nationkey") + by).alias("n_nationkey"), "n_name", (F.col("n_nationkey") + boss).alias("boss"))
    return insert(db, "nation", moved(100, 0).unionByName(moved(200, 100)))["nation"].df


@_query("SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = update(database(spark, sf_dir, "nation", "customer"), "customer", {"c_acctbal": 0.0}, lambda v: v.c_acctbal < 0)
    return db["customer"].df.select("c_custkey", "c_nationkey", "c_acctbal")


@_query("SELECT n_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey % 5 = 3")
def update_key_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows forbid that the keys of some nations change; the change itself is refused."""
    from .errors import ConstraintViolationError

    db = database(spark, sf_dir, "nation", "customer")
    try:
        update(db, "nation", {"n_nationkey": lambda v: v.n_nationkey + 1000}, lambda v: v.n_nationkey % 5 == 3)
    except ConstraintViolationError:
        blockers = reference_blockers(db, db.references[0], db["nation"].df.where("n_nationkey % 5 = 3"))
        return blockers.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    raise AssertionError("a key that others refer to was changed")


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "orders")
    return delete(db, "orders", db["orders"].df.where("o_totalprice < 100000").select("o_orderkey"))["orders"].df.select("o_orderkey")


@_query("SELECT count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS total FROM customer")
def checked_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a schema refuses leave the relation as it was."""
    from .errors import ConstraintViolationError

    db = database(spark, sf_dir, "customer")
    schema = Schema({f.name: f.dataType for f in db["customer"].df.schema})
    db = db.with_relations({"customer": db["customer"].with_constraint(schema)})
    try:
        db = insert(db, "customer", db["customer"].df.limit(5).withColumns({"c_custkey": F.col("c_custkey") + 10**6, "c_name": F.lit(1)}))
    except ConstraintViolationError:
        pass
    return aggregate(db["customer"], n=Count(), total=Sum("c_nationkey")).result.df


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database as it was stored and read again, references included."""
    import tempfile
    import uuid

    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    path = f"{folder}/catalog-{uuid.uuid4()}"
    catalog.save(database(spark, sf_dir, "region", "nation"), path)
    rows = join(catalog.load(spark, path)).result.df
    return rows.select("nation.n_name", "region.r_name")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_nationkey = 7")
def update_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "customer", "supplier")
    mine = db["customer"].where(c_nationkey=7)
    other = db["supplier"].where(s_nationkey=7).df.select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    whole = mine.with_df(mine.df.select("c_custkey", "c_name"))
    return whole.update(Relation(other, ("c_custkey",))).df.select("c_custkey", "c_name")


@_query("SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_linestatus")
def transform_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(database(spark, sf_dir, "lineitem")["lineitem"], transformation_function=lambda relation: relation.where(l_quantity__gt=25))
    return group_by_aggregate(rows, "l_linestatus", n=Count()).result.df


@_query("SELECT count(*) AS n, CAST(0 AS DOUBLE) AS largest FROM (SELECT unnest(embedding) FROM embeddings)")
def tensor_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor of all vectors less itself."""
    cells = database(spark, sf_dir, "embeddings")["embeddings"].df.select(F.col("vec_id").alias("c0"), F.posexplode("embedding").alias("c1", "value"))
    cells = cells.select("c0", "c1", F.col("value").cast("double").alias("value"))
    tensor = Tensor(cells, (1 << 62, 1 << 31))
    return (tensor - tensor).df.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("largest"))
