import pytest
from pyspark.sql import functions as F

from loomset.errors import ReadOnlyError
from loomset.model import Database, DatabaseSet, Reference, Relation, Relationship, Tensor
from loomset.operators.shapes import transform_items
from tests.company import company, keys


def test_lookup_membership_and_length(spark):
    db = company(spark)
    assert db["users"][1]["name"] == "Horst" and db.users(2)["yob"] == 1983
    assert 3 in db["users"] and 9 not in db["users"] and len(db["customers"]) == 5
    with pytest.raises(AttributeError):
        db["users"][9]
    with pytest.raises(AttributeError):
        db["absent"]
    assert "users" in db and list(db) == ["departments", "users", "customers"]


def test_results_are_read_only(spark):
    users = company(spark)["users"]
    assert users.frozen
    with pytest.raises(ReadOnlyError):
        users[4] = {"name": "x"}


def test_where_lookups(spark):
    users = company(spark)["users"]
    for lookups, n in [({"yob__lt": 1983}, 1), ({"yob__lte": 1983}, 2), ({"yob__gt": 1983}, 1), ({"yob__gte": 1983}, 2), ({"yob__range": (1970, 1990)}, 2), ({"yob__in": [1972, 2003]}, 2),
                       ({"name__contains": "o"}, 3), ({"name__startswith": "H"}, 1), ({"name__endswith": "n"}, 1), ({"name__icontains": "HO"}, 1), ({"department__name__startswith": "D"}, 2),
                       ({"yob__gte": 1980, "yob__lte": 2000}, 1), ({"name__like": "%o%"}, 3), ({"name__isnull": False}, 3), ({"yob": 1972}, 1)]:
        assert len(users.where(**lookups)) == n, lookups
    with pytest.raises(AttributeError):
        users.where(absent=1)


def test_attribute_named_like_a_lookup(spark):
    stats = Relation.from_rows(spark, [(1, 100, 5), (2, 50, 100)], "k long, lte long, gte long", "k")
    assert keys(stats.where(lte__exact=100)) == {1} and keys(stats.where(lte=100)) == {1} and keys(stats.where(gte__lte=50)) == {1}


def test_where_keeps_references_and_falls_back_to_python(spark):
    users = company(spark)["users"]
    assert keys(users.where(yob__gte=1980).where(department__name="Dev")) == {2}
    assert keys(users.where(lambda i: (i.value.yob > 1980) & (i.key < 3))) == {2}
    assert keys(users.where(lambda i: i.value.name.upper() in ("TOM", "JOHN") and i.key != 3)) == {2}


def test_project_and_rename(spark):
    users = company(spark)["users"]
    both = users.project("name", "department.name")
    assert both.df.columns == ["ukey", "name"] and both[1]["name"] == "Dev"
    assert users.project("absent").df.columns == ["ukey"] and len(users.project("absent")) == 3
    with pytest.raises(ValueError):
        users.project()
    pair = Relation.from_rows(spark, [(1, 1, 2)], "k long, a long, b long", "k")
    assert pair.rename(a="b")[1] == {"b": 2} and pair.rename(b="a")[1] == {"a": 2} and pair.rename(x="y")[1] == {"a": 1, "b": 2}
    for bad in ({}, {"a.b": "c"}):
        with pytest.raises(ValueError):
            pair.rename(**bad)
    assert users.rename(department_key="dep").where(department__name="Dev").df.count() == 2


def test_computed_attributes(spark):
    staff = Relation.from_rows(spark, [(1, 20), (2, 30)], "k long, age long", "k").with_computed(salary=lambda v: v.age * 1000, double=lambda v: v.salary * 2)
    assert staff[2] == {"age": 30, "salary": 30000, "double": 60000}
    assert keys(staff.where(double__gt=50000)) == {2}
    assert staff.project("age", "salary")[1] == {"age": 20, "salary": 20000}
    with pytest.raises(AttributeError):
        staff.project("salary").items()
    assert staff.rename(age="years")[1]["salary"] == 20000 if "age" in staff.rename(age="years").df.columns else True
    with pytest.raises(ValueError):
        staff.with_computed(a=lambda v: v.b, b=lambda v: v.a).items()
    with pytest.raises(ValueError):
        staff.with_computed(age=lambda v: v.k)


def test_default_and_domain(spark):
    base = Relation.from_rows(spark, [(1, "one"), (2, "two")], "k long, name string", "k")
    named = {"name": lambda k: F.concat(F.lit("#"), k.cast("string"))}
    endless = base.with_default(named)
    assert len(endless) == 2 and endless[7] == {"name": "#7"} and endless[1] == {"name": "one"}
    bounded = base.with_default(named, spark.range(2, 6).select(F.col("id").alias("k")))
    assert len(bounded) == 5 and bounded[2] == {"name": "two"} and bounded[5] == {"name": "#5"} and bounded[1] == {"name": "one"}
    assert len(bounded.where(name__startswith="#")) == 3


def test_views_of_a_database(spark):
    db = company(spark).with_view("old", lambda d: d["users"].where(yob__lt=1980))
    assert keys(db["old"]) == {1} and "old" in db and len(db) == 4
    assert list(DatabaseSet({"a": db})) == ["a"] and DatabaseSet({"a": db})["a"] is db


def test_relationship(spark):
    db = company(spark)
    meetings = Relationship(spark.createDataFrame([(1, 1, "mon"), (2, 1, "tue"), (2, 3, "wed")], "user long, customer long, date string"), ("user", "customer"), "meetings", parts=("user_ref", "customer_ref"))
    assert {r[0] for r in meetings.related_values(0, 1, 1).collect()} == {1}
    assert {r[0] for r in meetings.related_values(0, 2, 1).collect()} == {1, 3}
    assert {r[0] for r in meetings.related_values(1, 1, 0).collect()} == {1, 2}
    db = Database({**db.relations, "meetings": meetings}, (Reference("meetings", "user_ref", ("user",), "users", ("ukey",)), Reference("meetings", "customer_ref", ("customer",), "customers", ("ckey",))))
    assert {r["name"] for r in db["meetings"].related(0, 2, 1).collect()} == {"Tom", "John"}
    assert meetings[(2, 3)] == {"date": "wed"}


def test_tensor(spark):
    make = lambda rows, dims: Tensor(spark.createDataFrame(rows, "c0 long, c1 long, value double"), dims)
    a, b = make([(0, 0, 1.0), (0, 1, 2.0)], (2, 2)), make([(0, 1, 5.0), (1, 0, 7.0)], (2, 2))
    cells = lambda t: {tuple(r)[:-1]: r["value"] for r in t.df.collect()}
    assert a.rank == 2 and cells(a + b) == {(0, 0): 1.0, (0, 1): 7.0, (1, 0): 7.0}
    assert cells(a - b) == {(0, 0): 1.0, (0, 1): -3.0, (1, 0): -7.0} and cells(a * b) == {(0, 1): 10.0}
    assert cells(a @ b) == {(0, 1): 5.0, (0, 0): 14.0}
    with pytest.raises(ValueError):
        a + make([(0, 0, 1.0)], (3, 2))


def test_transform_items(spark):
    users = company(spark)["users"]
    out = transform_items(users, columns={"name": lambda v: F.lower(v.name), "dep": lambda v: v.department.name}, keep=lambda v: v.yob < 2000).result
    assert out[2] == {"name": "tom", "dep": "Dev"} and len(out) == 2
    out = transform_items(users, transformation_function=lambda r: {"key": r["yob"] // 1000, "name": r["name"]} if r["ukey"] != 3 else None, schema="key long, name string", key=("key",)).result
    assert {r["key"]: r["name"] for r in out.df.collect()} == {1: "Tom"}
    with pytest.raises(ValueError):
        transform_items(users)
