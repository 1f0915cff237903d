import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomset.functions.aggregates import Count, Max, Min
from loomset.functions.predicates import Gt
from loomset.model import Database, Reference
from loomset.operators.constraints import add_join_predicate, add_reference
from loomset.operators.grouping import aggregate
from loomset.operators.joins import cogroup, join, semijoin, subdatabase
from loomset.operators.shapes import flatten
from loomset.plans.graph import ReferenceGraph
from tests.company import company, graph, keys


def chain(spark):
    return graph(
        spark,
        {"departments": ("k string, name string", [("d1", "Dev"), ("d2", "Ops"), ("d3", "R")]), "projects": ("k string, dept string", [("p1", "d1"), ("p2", "d1"), ("p3", "d2")]), "tasks": ("k string, project string", [("t1", "p1"), ("t2", "p1")])},
        [("projects", "dept", "departments"), ("tasks", "project", "projects")],
    )


def star(spark):
    return graph(
        spark,
        {"customers": ("k string", [("c1",), ("c2",), ("c3",)]), "products": ("k string", [("x1",), ("x2",), ("x3",)]), "orders": ("k string, customer string, product string, amount long", [("o1", "c1", "x1", 100), ("o2", "c2", "x2", 200)])},
        [("orders", "customer", "customers"), ("orders", "product", "products")],
    )


def diamond(spark):
    return graph(
        spark,
        {"a": ("k string, b string, c string", [("a1", "b1", "c1"), ("a2", "b1", "c2")]), "b": ("k string, d string", [("b1", "d1")]), "c": ("k string, d string", [("c1", "d1"), ("c2", "d2")]), "d": ("k string", [("d1",), ("d2",)])},
        [("a", "b", "b"), ("a", "c", "c"), ("b", "d", "d"), ("c", "d", "d")],
    )


def test_semijoin_directions(spark):
    db = chain(spark)
    assert keys(semijoin(db, reduce="departments", by="projects", ref_key="dept").result["departments"]) == {"d1", "d2"}
    assert keys(semijoin(db, reduce="projects", by="tasks", ref_key="project").result["projects"]) == {"p1"}
    assert keys(semijoin(db, reduce="tasks", by="projects", ref_key="project").result["tasks"]) == {"t1", "t2"}
    assert keys(semijoin(db, reduce="projects", by="tasks", ref_key="project", anti=True).result["projects"]) == {"p2", "p3"}
    with pytest.raises(ValueError):
        semijoin(db, reduce="projects", by="tasks", ref_key="nope").result  # noqa: B018
    with pytest.raises(TypeError):
        semijoin(db["tasks"], reduce="a", by="b", ref_key="c").result  # noqa: B018


@pytest.mark.parametrize("strategy", ["auto", "cascade", "decompose"])
def test_subdatabase_trees(spark, strategy):
    out = subdatabase(chain(spark), strategy=strategy).result
    assert {n: keys(out[n]) for n in out} == {"departments": {"d1"}, "projects": {"p1"}, "tasks": {"t1", "t2"}}
    out = subdatabase(star(spark), strategy=strategy).result
    assert {n: keys(out[n]) for n in out} == {"customers": {"c1", "c2"}, "products": {"x1", "x2"}, "orders": {"o1", "o2"}}


def test_output_factory_and_persist(spark):
    assert subdatabase(chain(spark), output_factory=lambda db: sorted(db)).result == ["departments", "projects", "tasks"]
    kept = subdatabase(chain(spark), strategy="decompose", persist=True).result
    assert keys(kept["tasks"]) == {"t1", "t2"} and keys(kept["projects"]) == {"p1"}
    plan = subdatabase(chain(spark), strategy="cascade").result["projects"].df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 4 and "Python" not in plan


def test_subdatabase_other_graphs(spark):
    out = subdatabase(diamond(spark)).result
    assert {n: keys(out[n]) for n in out} == {"a": {"a1"}, "b": {"b1"}, "c": {"c1"}, "d": {"d1"}}
    with pytest.raises(ValueError):
        subdatabase(diamond(spark), strategy="cascade").result  # noqa: B018
    loose = graph(spark, {"r": ("k string", [("1",)]), "s": ("k string", [("2",)])}, [])
    assert subdatabase(loose).result is loose
    cycle = graph(spark, {"r": ("k string, s string", [("1", "2")]), "s": ("k string, r string", [("2", "1")])}, [("r", "s", "s"), ("s", "r", "r")])
    with pytest.raises(ValueError):
        subdatabase(cycle).result  # noqa: B018
    db = company(spark)
    db = db.with_relations({**db.relations, "users": db["users"].where(yob=1972)})
    out = subdatabase(db).result
    assert keys(out["departments"]) == {"d1"} and len(out["customers"]) == 5
    assert keys(subdatabase(db, anti=("departments",)).result["departments"]) == {"d2"}
    assert keys(subdatabase(db, keep=("departments",)).result["departments"]) == {"d1", "d2"}
    with pytest.raises(ValueError):
        subdatabase(db, root="absent").result  # noqa: B018


def test_graph():
    ref = lambda s, t: Reference(s, t, (t,), t, ("k",))
    g = ReferenceGraph("abcde", [ref("a", "b"), ref("b", "c"), ref("d", "c")])
    assert g.pure_sources() == ["a", "d"] and g.isolated() == ["e"] and g.components() == [["a", "b", "c", "d"], ["e"]]
    assert len(g.semijoins("c")) == 6 and g.root(["a", "b", "c", "d"]) == "c" and not g.trivial
    g.check_acyclic()
    with pytest.raises(ValueError):
        ReferenceGraph("ab", [ref("a", "b"), ref("b", "a")]).check_acyclic()


def test_join_shapes(spark):
    rows = join(chain(spark)).result
    assert {(r.tasks.k, r.projects.k, r.departments.name) for r in rows.df.collect()} == {("t1", "p1", "Dev"), ("t2", "p1", "Dev")}
    assert {(r.orders.k, r.customers.k, r.products.k) for r in join(star(spark)).result.df.collect()} == {("o1", "c1", "x1"), ("o2", "c2", "x2")}
    assert [r.a.k for r in join(diamond(spark)).result.df.collect()] == ["a1"]
    multi = graph(spark, {"t": ("k string", [("t1",)]), "ci": ("k string, t string", [("c", "t1")]), "mc": ("k string, t string", [("m", "t1")])}, [("ci", "t", "t"), ("mc", "t", "t")])
    assert join(multi).result.df.count() == 1
    single = company(spark).subset("users")
    assert {r.users.name for r in join(single).result.df.collect()} == {"Horst", "Tom", "John"}
    assert [r.row for r in join(chain(spark), numbered=True).result.df.orderBy("row").collect()] == [0, 1]


def test_join_refusals_and_predicates(spark):
    loose = graph(spark, {"a": ("k long, x long", [(1, 5), (2, 9)]), "b": ("k long, y long", [(1, 7)])}, [])
    with pytest.raises(ValueError):
        join(loose).result  # noqa: B018
    assert join(loose, cross=True).result.df.count() == 2
    less = add_join_predicate(loose, "a", "b", predicate=lambda a, b: a.x < b.y)
    assert [r.a.k for r in join(less).result.df.collect()] == [1]
    with pytest.raises(ValueError):
        join(loose, root="zz").result  # noqa: B018


def test_flatten(spark):
    db = company(spark)
    flat = flatten(join(db.subset("users", "departments"))).result
    rows = {(r["users.name"], r["departments.name"], r["users.department.name"]) for r in flat.df.collect()}
    assert rows == {("Horst", "Dev", "Dev"), ("Tom", "Dev", "Dev"), ("John", "Consulting", "Consulting")}
    deep = flatten(join(chain(spark))).result.df.columns
    assert {"tasks.k", "projects.k", "departments.name", "projects.dept.name", "tasks.project.k", "tasks.project.dept.name"} <= set(deep)
    found = aggregate(flat, n=Count(), first=Min("users.name"), last=Max("departments.name")).result.df.first()
    assert (found.n, found.first, found.last) == (3, "Horst", "Dev")
    with pytest.raises(TypeError):
        flatten(db).result  # noqa: B018
    assert flatten(join(db.with_relations({**db.relations, "users": db["users"].where(yob=0)}).subset("users", "departments"))).result.df.count() == 0


def test_cogroup(spark):
    db = company(spark).subset("users", "customers")
    by_key = {r.ukey: r for r in cogroup(db).result.df.collect()}
    assert len(by_key) == 5 and by_key[4].users is None and by_key[4].customers.name == "Peter" and by_key[1].users.yob == 1972
    by_name = {r.name: r for r in cogroup(db, {"users": "name", "customers": "name"}).result.df.collect()}
    assert set(by_name) == {"Horst", "Tom", "John", "Peter", "Frank"} and set(by_name["Tom"].customers) == {1, 2} and set(by_name["Tom"].users) == {2} and by_name["Peter"].users is None
    counts = cogroup(db, {"users": ("name",), "customers": ("name",)}, aggregates={"users": {"n": Count()}, "customers": {"n": Count()}}).result.df
    assert {r.name: (r.users__n, r.customers__n) for r in counts.collect()}["Tom"] == (1, 2)
    with pytest.raises(KeyError):
        cogroup(db, {"users": "name"}).result  # noqa: B018
    with pytest.raises(ValueError):
        cogroup(db.subset("users")).result  # noqa: B018


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=8), st.lists(st.integers(0, 4), min_size=1, max_size=5, unique=True), st.lists(st.integers(0, 4), min_size=1, max_size=5, unique=True))
def test_reduction_is_the_projection_of_the_join(spark, facts, lefts, rights):
    db = graph(
        spark,
        {"f": ("k long, l long, r long", [(i, a, b) for i, (a, b) in enumerate(facts)]), "left": ("k long", [(x,) for x in lefts]), "right": ("k long", [(x,) for x in rights])},
        [("f", "l", "left"), ("f", "r", "right")],
    )
    rows = join(db).result.df.collect()
    want = {"f": {r.f.k for r in rows}, "left": {r.left.k for r in rows}, "right": {r.right.k for r in rows}}
    for strategy in ("cascade", "decompose"):
        out = subdatabase(db, strategy=strategy).result
        assert {n: keys(out[n]) for n in out} == want


def test_references_by_operator(spark):
    db = graph(spark, {"a": ("k long, b_key long", [(1, 1), (2, 9)]), "b": ("k long", [(1,)])}, [])
    db = add_reference(db, source="a", ref_key="b", target="b", columns="b_key").result
    assert keys(db["a"].where(Gt("b.k", 0) if False else None, b__k=1)) == {1}
    assert isinstance(db, Database) and join(db).result.df.count() == 1


def comparable(spark):
    """Two relations with shared, missing and odd values."""
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    a = [(i, None if i % 11 == 0 else i % 3, odd[i % 5] if i % 7 == 0 else float(i * 37 % 50)) for i in range(90)]
    b = [(i, None if i % 13 == 0 else i % 4, odd[i % 5] if i % 9 == 0 else float(i * 29 % 50)) for i in range(110)]
    return graph(spark, {"a": ("k long, g int, x double", a), "b": ("k long, h int, y double", b)}, [])


@pytest.mark.parametrize("turned", [False, True])
def test_declared_comparisons_join_as_predicates_do(spark, turned):
    names = ("b", "a") if turned else ("a", "b")
    db = comparable(spark)
    loose = add_join_predicate(add_join_predicate(db, "a", "b", predicate=lambda a, b: a.g == b.h), *names, predicate=(lambda b, a: b.y > a.x) if turned else (lambda a, b: a.x > b.y))
    tight = add_join_predicate(add_join_predicate(db, "a", "b", equal=(lambda a: a.g, lambda b: b.h)), *names, above=(lambda b: b.y, lambda a: a.x) if turned else (lambda a: a.x, lambda b: b.y))
    pairs = lambda db: sorted(tuple(r) for r in join(db).result.df.select("a.k", "b.k").collect())
    assert pairs(tight) == pairs(loose) and len(pairs(loose)) > 500
    for wrong in ({}, {"equal": (len, len), "above": (len, len)}):
        with pytest.raises(ValueError):
            add_join_predicate(db, "a", "b", **wrong)
    with pytest.raises(TypeError):
        add_join_predicate(db, "a", equal=(len, len))


def test_a_join_over_an_inequality_looks_at_few_pairs_besides_its_result(spark):
    from pyspark.sql import functions as F

    from loomset.operators.joins import _in_ranges

    rows = spark.range(3000).select(((F.col("id") * 7919) % 3000).cast("double").alias("x"))
    high, low = _in_ranges(rows.select(F.col("x").alias("__high")), rows.select((F.col("x") + 2000).alias("__low")))
    met = high.join(low, F.col("__h") == F.col("__l")).cache()
    found, want = met.where("__high > __low").count(), 999 * 1000 // 2
    assert found == want and met.count() < 1.1 * want


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("above", [False, True])
def test_partners_are_counted_without_pairs(spark, turned, equal, above):
    from pyspark.sql import functions as F

    from loomset.operators.joins import partner_counts

    db = comparable(spark)
    if equal:
        db = add_join_predicate(db, "b", "a", equal=(lambda b: b.h, lambda a: a.g)).result
    if above:
        db = (add_join_predicate(db, "b", "a", above=(lambda b: b.y, lambda a: a.x)) if turned else add_join_predicate(db, "a", "b", above=(lambda a: a.x, lambda b: b.y))).result
    if not (equal or above):
        with pytest.raises(ValueError):
            partner_counts(db, "a", "b").result  # noqa: B018
        return
    for one, other in (("a", "b"), ("b", "a")):
        want = join(db).result.df.groupBy(f"{one}.k").agg(F.count(F.lit(1)).alias("n")).collect()
        counted = partner_counts(db, one, other, name="n").result
        assert sorted(map(tuple, counted.df.select("k", "n").collect())) == sorted(map(tuple, want)) and len(want) > 50
    opaque = add_join_predicate(db, "a", "b", predicate=lambda a, b: a.x + b.y > 0)
    with pytest.raises(ValueError):
        partner_counts(opaque, "a", "b").result  # noqa: B018
