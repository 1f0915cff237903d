import json

import pytest
from pyspark.sql import functions as F

from loomset.errors import ConstraintViolationError
from loomset.functions.aggregates import AggregationFunction, Avg, Count, Max, Mean, Median, Min, Sum
from loomset.functions.predicates import Eq, Gt
from loomset.model import Database, Relation
from loomset.operators import constraints as C
from loomset.operators.filters import filter_keys, filter_values
from loomset.operators.grouping import above_average, aggregate, cube, group_by, group_by_aggregate, partition, partition_by_aggregate
from loomset.operators.ranking import items_sorted_by, numbered, rank_by, subset
from loomset.operators.sets import V, difference, intersect, minus, union, values_union, Ʌ
from loomset.operators.shapes import disaggregate, project, transform
from loomset.plans.ir import LogicalPlan, extract
from loomset.sources import catalog
from tests.company import company, keys


def test_aggregates(spark):
    users = company(spark)["users"]
    row = aggregate(users, lo=Min("yob"), hi=Max("yob"), n=Count("yob"), total=Sum("yob"), mean=Avg("yob"), also=Mean("yob"), med=Median("yob"), named=lambda v: F.count_distinct(v.department.name)).result.df.first()
    assert tuple(row) == (1972, 2003, 3, 5958, 1986.0, 1986.0, 1983.0, 2)
    spread = aggregate(users, spread=AggregationFunction(lambda v: float(max(v) - min(v)), "yob")).result.df.first().spread
    assert spread == 31.0
    empty = users.where(yob=0)
    row = aggregate(empty, lo=Min("yob"), n=Count(), total=Sum("yob"), mean=Avg("yob")).result.df.first()
    assert tuple(row) == (None, 0, 0, None)
    with pytest.raises(ValueError):
        aggregate(empty, strict=True, lo=Min("yob")).result  # noqa: B018
    nulls = Relation.from_rows(spark, [(1, None), (2, 3)], "k long, x long", "k")
    assert aggregate(nulls, n=Count("x")).result.df.first().n == 2
    assert aggregate(company(spark).subset("users", "customers"), n=Count()).result["customers"].df.first().n == 5


def test_groups(spark):
    customers, users = company(spark)["customers"], company(spark)["users"]
    by_name = group_by_aggregate(customers, "name", n=Count()).result
    assert {r["name"]: r.n for r in by_name.df.collect()} == {"Tom": 2, "John": 1, "Peter": 1, "Frank": 1} and by_name["Tom"] == {"n": 2}
    assert len(group_by_aggregate(customers, "name", "company", n=Count()).result) == 4
    tom = partition_by_aggregate(users, partitioning_function=lambda i: i.value.name == "Tom", lo=Min("yob"), hi=Max("yob")).result
    assert {r.partition: (r.lo, r.hi) for r in tom.df.collect()} == {True: (1983, 1983), False: (1972, 2003)}
    assert {r["name"]: r.n for r in group_by_aggregate(users, "department.name", n=Count()).result.df.collect()} == {"Dev": 2, "Consulting": 1}
    parts = partition(customers, partitioning_function=lambda i: i.value.name == "Tom").result
    assert keys(parts[True]) == {1, 2} and keys(parts[False]) == {3, 4, 5} and len(parts) == 2 and parts[True].df.columns == customers.df.columns
    groups = group_by(customers, "name", "company").result
    assert keys(groups[("Tom", "whatever gmbh")]) == {1, 2} and len(groups) == 4 and {r.n for r in groups.counts().collect()} == {1, 2}
    for bad in (group_by, group_by_aggregate):
        with pytest.raises(ValueError):
            bad(customers)
    made = cube(customers, "name", "company", n=Count()).result
    assert list(made) == ["name/company", "name", "company", "all"] and made["all"].df.first().n == 5 and len(made["company"]) == 3
    assert sum(r.n for r in by_name.df.collect()) == len(customers)


def test_rank_and_subset(spark):
    users = company(spark)["users"]
    ties = Relation.from_rows(spark, [("a", 1), ("b", 2), ("c", 1)], "k string, v long", "k")
    ranks = rank_by(ties, ranking_key=lambda i: i.value.v, keep_key=True).result
    assert {r.k: r["rank"] for r in ranks.df.collect()} == {"a": 0, "c": 1, "b": 2}
    assert {r.k: r["rank"] for r in rank_by(ties, ranking_key="v", reverse=True, keep_key=True).result.df.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r.k: r["rank"] for r in rank_by(ties, ranking_key="k", reverse=True, keep_key=True).result.df.collect()} == {"c": 0, "b": 1, "a": 2}
    assert rank_by(users, ranking_key="yob").result[1]["name"] == "Tom"
    assert keys(filter_keys(rank_by(users, ranking_key="yob"), lambda r: r < 2).result) == {0, 1}
    inner = rank_by(users, ranking_key="yob", partition_by=("department_key",)).result
    assert {(r.department_key, r["rank"]): r["name"] for r in inner.df.collect()} == {("d1", 0): "Horst", ("d1", 1): "Tom", ("d2", 0): "John"}
    assert keys(users.top(2, "yob")) == {1, 2} and keys(users.bottom(2, lambda i: i.value.yob)) == {2, 3} and keys(users.top(9, "yob")) == {1, 2, 3}
    assert keys(subset(users, subset_predicate=above_average("yob")).result) == {3}
    assert list(subset(company(spark), ranking_key=len, k=1).result) == ["departments"]
    assert [r["name"] for r in items_sorted_by(users, sorting_key="yob", reverse=True).result] == ["John", "Tom", "Horst"]
    for make in (lambda: subset(users, ranking_key="yob", k=0), lambda: subset(users), lambda: subset(users, ranking_key="yob", k=1, subset_predicate=len)):
        with pytest.raises(ValueError):
            make()
    for make in (lambda: rank_by(users, ranking_key=5), lambda: subset(users, ranking_key=5, k=1), lambda: items_sorted_by(users, sorting_key=5)):
        with pytest.raises(TypeError):
            make()
    plan = subset(users, ranking_key="yob", k=2).result.df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id")
    found = numbered(df, [F.col("v"), F.col("id")], "n")
    assert [r.n for r in found.orderBy("v").collect()] == list(range(1000))
    same = numbered(spark.range(50).select(F.lit(1).alias("v"), "id"), [F.col("v"), F.col("id")], "n")
    assert [r.n for r in same.orderBy("id").collect()] == list(range(50))
    words = spark.createDataFrame([(w, i) for i, w in enumerate("delta alpha echo bravo charlie alpha golf".split())] + [(None, 9)], "v string, id long")
    assert [r.v for r in numbered(words, [F.col("v"), F.col("id")], "n").orderBy("n").collect()] == [None, "alpha", "alpha", "bravo", "charlie", "delta", "echo", "golf"]
    assert [(r.v, r.id) for r in numbered(words, [F.col("v"), F.col("id")], "n", reverse=True).orderBy("n").collect()][-3:] == [("alpha", 1), ("alpha", 5), (None, 9)]
    times = spark.range(60).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id") * 37 % 60)).alias("v"), "id")
    assert [r.n for r in numbered(times, [F.col("v"), F.col("id")], "n").orderBy("v").collect()] == list(range(60))
    with_null = spark.createDataFrame([(None, 1), (3, 2), (None, 3), (1, 4)], "v long, id long")
    assert [(r.id, r.n) for r in numbered(with_null, [F.col("v"), F.col("id")], "n").orderBy("n").collect()] == [(1, 0), (3, 1), (4, 2), (2, 3)]


def test_set_operations(spark):
    db = company(spark).subset("users", "customers")
    both = union(db).result
    assert keys(both) == {1, 2, 3, 4, 5} and both[1]["name"] == "Tom" and both[1]["yob"] is None
    assert keys(intersect(db).result) == {1, 2, 3} and intersect(db).result[1]["name"] == "Horst"
    assert keys(minus(db).result) == set() and keys(difference(db.subset("customers", "users")).result) == {4, 5}
    assert keys(V(db["users"], db["customers"])) == {1, 2, 3, 4, 5} and keys(Ʌ(db["users"], db["customers"])) == {1, 2, 3}
    a, b = db["users"].where(ukey__lt=2), db["users"].where(ukey__gte=2)
    assert keys(union(Database({"a": a, "b": b}), disjoint=True).result) == {1, 2, 3}
    assert keys(db["users"].update(Relation.from_rows(spark, [(1, "Else", 1, "d1")], "ukey long, name string, yob long, department_key string", "ukey"))) == {1, 2, 3}
    names = values_union(Database({"u": db["users"].project("name"), "c": db["customers"].project("name")})).result
    assert {r["name"] for r in names.df.collect()} == {"Horst", "Tom", "John", "Peter", "Frank"}
    with pytest.raises(ValueError):
        union(db.subset("users")).result  # noqa: B018


def test_other_shapes(spark):
    lists = Relation(spark.createDataFrame([(1, [5, 6]), (2, [])], "k long, x array<long>"), ("k",))
    assert [tuple(r) for r in disaggregate(lists, "x").result.df.collect()] == [(1, 0, 5), (1, 1, 6)]
    assert transform(lists, transformation_function=lambda r: len(r)).result == 2


def test_references_and_join_predicates(spark):
    db = company(spark)
    db = C.drop_reference(db, source="users", ref_key="department", target="departments").result
    assert not db.references
    for bad in ({"source": "", "ref_key": "a", "target": "b"},):
        with pytest.raises(ValueError):
            C.add_reference(db, **bad)
    for bad in ({"source": "users", "ref_key": "department", "target": "absent"}, {"source": "users", "ref_key": "absent", "target": "departments"}):
        with pytest.raises(ValueError):
            C.add_reference(db, **bad).result  # noqa: B018
    with pytest.raises(TypeError):
        C.add_reference(db["users"], source="users", ref_key="department_key", target="departments").result  # noqa: B018
    with pytest.raises(ValueError):
        C.drop_reference(db, source="users", ref_key="department", target="departments").result  # noqa: B018
    again = C.add_reference(db, source="users", ref_key="department", target="departments", columns="department_key", validate=True).result
    assert keys(again["users"].where(department__name="Dev")) == {1, 2}
    with pytest.raises(ConstraintViolationError):
        C.add_reference(db, source="customers", ref_key="dep", target="departments", columns="name", validate=True).result  # noqa: B018
    predicate = lambda u, c: u.name == c.name
    with_p = C.add_join_predicate(db, "users", "customers", predicate=predicate, description="same name").result
    for options in ({"description": "same name"}, {"predicate": predicate}, {"matcher": lambda p: "users" in p.relations}):
        assert not C.drop_join_predicate(with_p, **options).result.join_predicates
    assert C.drop_join_predicate(with_p, matcher=lambda p: False).result.join_predicates
    with pytest.raises(ValueError):
        C.drop_join_predicate(with_p, description="other").result  # noqa: B018
    for options in ({}, {"description": "a", "predicate": predicate}):
        with pytest.raises(ValueError):
            C.drop_join_predicate(with_p, **options)
    with pytest.raises(TypeError):
        C.add_join_predicate(db, "users", predicate=5)


def test_checked_versions(spark):
    events = []
    base = company(spark)
    db = Database(base.relations, base.references, observers=(lambda e, n, d: events.append((e, n)),))
    row = lambda *r: spark.createDataFrame([r], "ukey long, name string, yob long, department_key string")
    more = C.insert(db, "users", row(4, "Ann", 1990, "d2"))
    assert keys(more["users"]) == {1, 2, 3, 4} and keys(db["users"]) == {1, 2, 3}
    assert C.insert(more, "users", row(4, "Anna", 1990, "d1"))["users"][4]["name"] == "Anna"
    with pytest.raises(ConstraintViolationError):
        C.insert(db, "users", row(5, "Eve", 1990, "d9"))
    with pytest.raises(ConstraintViolationError):
        C.delete(db, "departments", spark.createDataFrame([("d1",)], "dkey string"))
    fewer = C.delete(db, "users", spark.createDataFrame([(3,)], "ukey long"))
    assert keys(C.delete(fewer, "departments", spark.createDataFrame([("d2",)], "dkey string"))["departments"]) == {"d1"}
    older = C.update(db, "users", {"yob": lambda v: v.yob - 1}, Eq("name", "Tom"))
    assert older["users"][2]["yob"] == 1982 and older["users"][1]["yob"] == 1972
    with pytest.raises(ConstraintViolationError):
        C.update(db, "users", {"department_key": "d9"})
    assert events == [("INSERT", "users"), ("UPDATE", "users"), ("DELETE", "users"), ("DELETE", "departments"), ("UPDATE", "users")]


def test_constraints(spark):
    base = company(spark)
    row = spark.createDataFrame([(4, "Ann", 1990, "d2")], "ukey long, name string, yob long, department_key string")
    for constraint, bad in [(C.Schema({"name": str, "yob": int, "department_key": str}), row.withColumn("extra", F.lit(1))), (C.Schema({"name": str, "yob": str, "department_key": str}), row), (C.MaxCount(3), row),
                            (C.InSubset("name", ("Bob",)), row), (C.SameAttributes(frozenset({"name"})), row)]:
        db = base.with_relations({**base.relations, "users": base.relations["users"].with_constraint(constraint)})
        with pytest.raises(ConstraintViolationError):
            C.insert(db, "users", bad)
        free = db.with_relations({**db.relations, "users": db.relations["users"].without_constraint(constraint)})
        assert len(C.insert(free, "users", row)["users"]) == 4
    db = base.with_relations({**base.relations, "users": base.relations["users"].with_constraint(C.Schema({"name": str, "yob": int, "department_key": str, "more": str}), C.MaxCount(4), C.InSubset("name", ("Ann",)))})
    assert len(C.insert(db, "users", row)["users"]) == 4


def test_plans(spark):
    users = company(spark)["users"]
    op = group_by_aggregate(filter_values(project(users, "name", "yob"), Gt("yob", 1980)), "name", n=Count())
    plan = op.to_plan()
    text = plan.explain()
    assert text.splitlines()[0].startswith("- group_by_aggregate(") and "filter_values" in text and "leaf relation users" in text
    again = LogicalPlan.from_json(plan.to_json())
    assert again.to_json() == plan.to_json() and again.root.inputs[0].params["filter_predicate"] == Gt("yob", 1980)
    data = json.loads(filter_values(users, lambda v: v.yob > 1).to_plan().to_json())
    assert data["root"]["params"]["filter_predicate"] == {"$": "opaque", "reason": "callable"}
    assert extract(company(spark)).root.params["names"] == ["departments", "users", "customers"] and extract({"u": users}).root.op == "bind" and extract(5).root.op == "literal"
    with pytest.raises(ValueError):
        LogicalPlan.from_dict({"version": 99, "root": {}})
    with pytest.raises(ValueError):
        LogicalPlan.from_dict({"root": {"$": "nope"}})
    assert LogicalPlan.from_dict({"root": plan.root.to_dict()}).to_json() == plan.to_json()


def test_catalog_and_html(spark, tmp_path):
    db = company(spark)
    path = str(tmp_path / "store")
    catalog.save(db, path)
    again = catalog.load(spark, path)
    assert list(again) == list(db) and keys(again["users"].where(department__name="Dev")) == {1, 2} and catalog.unique_keys(again["users"])
    with pytest.raises(Exception, match="already exists"):
        catalog.save(db, path)
    page = db.to_html(sizes=True)
    assert page == db.to_html(sizes=True) and "users.department" in page and "(5)" in page
    odd = Database({"<script>": db["users"]})
    assert "<script>alert" not in odd.to_html() and "&lt;script&gt;" in odd.to_html()
    db["users"].df.write.option("header", True).csv(str(tmp_path / "c"))
    assert len(catalog.read(spark, str(tmp_path / "c"), "ukey", format="csv", header="true")) == 3


def test_a_python_aggregate_sees_slices_only(spark, monkeypatch):
    from loomset.functions import aggregates as A
    from loomset.operators.grouping import partition_by_aggregate

    monkeypatch.setattr(A, "SLICE", 7)
    rows = [(i, None if i % 5 == 0 else f"g{i % 3}", (i % 2, "x"), None if i % 4 == 0 or i % 3 == 1 else i * 0.5) for i in range(200)]
    data = Relation(spark.createDataFrame(rows, "k long, g string, s struct<a: int, b: string>, v double").repartition(3), ("k",))

    def some(values):
        assert 0 < len(values) <= 7
        return len(values), sum(values)

    def all_of(parts):
        return sum(n for n, _ in parts), sum(x for _, x in parts)

    mean = A.SlicedAggregation(some, "v", "double", merge=all_of, finish=lambda made: made[1] / made[0])
    for keys in (("g",), ("s",), ("g", "s")):
        found = group_by_aggregate(data, *keys, n=Count(), mean=mean, want=Avg("v")).result.df.collect()
        assert len(found) == data.df.select(*keys).distinct().count() and sum(r.n for r in found) == 200
        assert all(r.mean == r.want or abs(r.mean - r.want) < 1e-9 for r in found)
    assert any(r.mean is None for r in group_by_aggregate(data, "g", mean=mean).result.df.collect())
    parts = partition_by_aggregate(data, partitioning_function=lambda i: i.key % 2, mean=mean, want=Avg("v")).result.df.collect()
    assert len(parts) == 2 and all(abs(r.mean - r.want) < 1e-9 for r in parts)
    whole = aggregate(data, want=Avg("v"), mean=mean).result.df.first()
    assert abs(whole.mean - whole.want) < 1e-9
    nothing = aggregate(data.with_df(data.df.where("k < 0")), n=Count(), mean=mean).result.df.collect()
    assert [tuple(r) for r in nothing] == [(0, None)]
