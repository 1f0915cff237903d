import pytest

from loomset.errors import ConstraintViolationError
from loomset.model import Database, Relation
from loomset.operators.constraints import add_reference, insert, update
from loomset.operators.filters import filter_items, filter_items_scan_complement, filter_keys, filter_values
from loomset.operators.joins import cogroup
from loomset.operators.ranking import items_sorted_by, numbered, rank_by
from tests.company import company


def test_operators_take_a_database(spark):
    db = company(spark)
    small = lambda relation: len(relation) < 3
    assert list(filter_values(db, small).result) == ["departments"]
    assert list(filter_items(db, lambda item: item.key != "users" and len(item.value) > 3).result) == ["customers"]
    assert list(filter_keys(db, lambda name: name.startswith("c")).result) == ["customers"]
    assert set(filter_items_scan_complement(db, lambda item: item.key == "users").result) == {"departments", "customers"}
    ranked = rank_by(db, ranking_key=len, reverse=True).result
    assert [len(ranked[i]) for i in range(3)] == [5, 3, 2]
    assert [n for n, _ in items_sorted_by(db, sorting_key=len).result] == ["departments", "users", "customers"]
    with pytest.raises(TypeError):
        rank_by(db, ranking_key="name").result


def test_contains_looks_into_lists(spark):
    rows = Relation(spark.createDataFrame([(1, ["a", "b"], "ab"), (2, ["c"], "c"), (3, None, None)], "k int, xs array<string>, x string"), ("k",))
    assert [r.k for r in rows.where(xs__contains="b").df.collect()] == [r.k for r in rows.where(x__contains="b").df.collect()] == [1]


@pytest.mark.parametrize("reverse", [False, True])
def test_numbers_inside_ties(spark, reverse):
    rows = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"v{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(5)
    found = [r.k for r in numbered(df, [df.v, df.k], "n", reverse).orderBy("n").collect()]
    by_value = sorted({v for _, v in rows}, key=lambda v: (v is not None, v or ""), reverse=reverse)
    assert found == [k for value in by_value for k, v in rows if v == value]
    assert [r.n for r in numbered(df, [df.v, df.k], "n").orderBy("n").collect()] == list(range(500)) and numbered(df.where("false"), [df.v, df.k], "n").count() == 0


def test_self_references_and_moved_keys(spark):
    people = Relation.from_rows(spark, [(1, None), (2, 1)], "id int, boss int", "id", "people")
    db = add_reference(Database({"people": people}), source="people", ref_key="leader", target="people", columns="boss").result
    rows = lambda *r: spark.createDataFrame(r, "id int, boss int")
    assert len(insert(db, "people", rows((3, 1), (4, 3)))["people"]) == 4
    with pytest.raises(ConstraintViolationError):
        insert(db, "people", rows((3, 9)))
    with pytest.raises(ConstraintViolationError):
        update(db, "people", {"id": 7}, lambda v: v.boss.isNull())
    with pytest.raises(ConstraintViolationError):
        update(db, "people", {"id": 5})
    assert {r.id for r in update(db, "people", {"id": 7}, lambda v: v.boss == 1)["people"].df.collect()} == {1, 7}


def test_targets_need_unique_keys_and_groups_need_none(spark):
    lines = Relation(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "o int, p string"), ())
    heads = Relation.from_rows(spark, [(1, "A"), (1, "B")], "o int, n string", "o")
    with pytest.raises(ConstraintViolationError):
        add_reference(Database({"lines": lines, "heads": heads}), source="lines", ref_key="head", target="heads", columns="o").result
    found = cogroup(Database({"lines": lines, "heads": heads.with_df(heads.df.limit(1))}), {"lines": "o", "heads": "o"}).result.df
    assert {r.o: len(r.lines) for r in found.collect()} == {1: 2, 2: 1}
