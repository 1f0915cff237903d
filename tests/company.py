"""Small literal databases."""

from loomset.model import Database, Reference, Relation


def company(spark):
    departments = Relation.from_rows(spark, [("d1", "Dev", "11M"), ("d2", "Consulting", "22M")], "dkey string, name string, budget string", "dkey", "departments")
    users = Relation.from_rows(spark, [(1, "Horst", 1972, "d1"), (2, "Tom", 1983, "d1"), (3, "John", 2003, "d2")], "ukey long, name string, yob long, department_key string", "ukey", "users")
    customers = Relation.from_rows(
        spark,
        [(1, "Tom", "whatever gmbh"), (2, "Tom", "whatever gmbh"), (3, "John", "whatever gmbh"), (4, "Peter", "Peter, Paul, and Mary Inc."), (5, "Frank", "Masterhorst")],
        "ckey long, name string, company string", "ckey", "customers",
    )
    return Database({"departments": departments, "users": users, "customers": customers}, (Reference("users", "department", ("department_key",), "departments", ("dkey",)),), name="company")


def graph(spark, relations, edges):
    """relations: name to rows (key, value, foreign keys ...); edges: (source, column, target)."""
    made = {}
    for name, (schema, rows) in relations.items():
        made[name] = Relation.from_rows(spark, rows, schema, "k", name)
    return Database(made, tuple(Reference(s, c, (c,), t, ("k",)) for s, c, t in edges))


def keys(relation):
    return {r[0] for r in relation.keys().collect()}
