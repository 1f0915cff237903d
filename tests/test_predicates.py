import pytest

from loomset.functions.predicates import And, Eq, Gt, Gte, In, Like, Lt, Lte, Not, Or, Predicate, Ref
from loomset.model import Relation
from loomset.operators.filters import filter_items, filter_items_scan_complement, filter_keys, filter_values
from tests.company import company, keys

ALL = [
    (Eq("name", "Tom"), {2}), (Eq("department.name", "Dev"), {1, 2}), (Eq("department__name", "Dev"), {1, 2}), (Gt("yob", 1983), {3}), (Lt("yob", 1983), {1}), (Gte("yob", 1983), {2, 3}), (Lte("yob", 1983), {1, 2}),
    (Like("name", "%o%"), {1, 2, 3}), (Like("name", "H%"), {1}), (Like("name", "%n"), {3}), (Like("name", "Tom"), {2}), (Like("name", "H_rst"), set()), (Like("name", "%"), {1, 2, 3}), (Like("name", "H_rst", sql=True), {1}),
    (In("yob", [1972, 2003]), {1, 3}), (In("yob", []), set()), (And(), {1, 2, 3}), (Or(), set()), (And(Gt("yob", 1972), Eq("department.name", "Dev")), {2}), (Or(Eq("name", "Tom"), Eq("yob", 2003)), {2, 3}),
    (Not(Eq("name", "Tom")), {1, 3}), (Eq("name", Ref("name")), {1, 2, 3}), (Gt("yob", Ref("ukey")), {1, 2, 3}),
]


@pytest.mark.parametrize("predicate, want", ALL, ids=lambda x: repr(x)[:40])
def test_filter_and_json(spark, predicate, want):
    users = company(spark)["users"]
    assert keys(filter_values(users, predicate).result) == want
    again = Predicate.from_dict(predicate.to_dict())
    assert again == predicate and again.to_json() == predicate.to_json()


def test_plain_objects():
    horst = {"name": "Horst", "yob": 1972, "department": {"name": "Dev"}}
    assert And(Eq("department.name", "Dev"), Not(In("yob", [1])), Like("name", "%st"), Or(Lt("yob", 1), Gte("yob", 1972)))(horst)
    with pytest.raises(AttributeError):
        Eq("absent", 1)(horst)


def test_errors(spark):
    users = company(spark)["users"]
    for make in (lambda: Eq("a..b", 1), lambda: Eq("", 1), lambda: Like("name", "a%b"), lambda: Predicate.from_dict({"type": "predicate", "op": "nope"})):
        with pytest.raises(ValueError):
            make()
    for path in ("absent", "department.absent", "department"):
        with pytest.raises(AttributeError):
            filter_values(users, Eq(path, 1)).result  # noqa: B018


def test_null_is_two_valued(spark):
    rows = Relation.from_rows(spark, [(1, "a"), (2, None)], "k long, x string", "k")
    is_a = Eq("x", "a")
    assert keys(filter_values(rows, Not(is_a)).result) == {2} and keys(filter_items_scan_complement(rows, is_a).result) == {2}
    assert keys(rows.where(x__isnull=True)) == {2} and keys(rows.where(x=None)) == {2} and keys(rows.where(x__contains="a")) == {1}


def test_filter_kinds(spark):
    db = company(spark)
    assert keys(filter_items(db["users"], lambda i: (i.key > 1) & (i.value.department.name == "Dev")).result) == {2}
    assert keys(filter_keys(db["users"], lambda k: k < 3).result) == {1, 2}
    assert list(filter_keys(db, lambda name: name != "users").result) == ["departments", "customers"]
    assert keys(filter_items_scan_complement(db["users"], lambda i: i.value.department.name == "Dev").result) == {3}
    # An operator is an input, too, and builds its result once.
    inner = filter_values(db["users"], Gt("yob", 1972))
    outer = filter_values(inner, Eq("name", "Tom"))
    assert keys(outer()) == {2} and outer.result is outer.result
    with pytest.raises(NotImplementedError):
        filter_items(db["users"], lambda i: True, create_lineage=True)
    with pytest.raises(TypeError):
        filter_values(5, Gt("a", 1)).result  # noqa: B018


def test_pushdown_and_no_python(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS k", "id * 2 AS v", "'x' AS other").write.parquet(path)
    found = filter_values(Relation(spark.read.parquet(path), ("k",)), And(Gt("v", 10), Eq("k", 7))).result.project("v").df
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(v,10)" in plan and "other" not in plan and "Python" not in plan
