from pyspark.sql import functions as F

from loomset.functions.predicates import Eq
from loomset.model import Database, Relation
from loomset.operators.filters import filter_values
from loomset.operators.constraints import insert
from loomset.sources.catalog import commit, current, save
from loomset.streaming.events import deduplicated, ingest, read_stream, run_available, sessions, windowed

SCHEMA = "event_id long, ts timestamp, user long, value double"


def _write(spark, path):
    rows = [(1, "2024-01-01 10:00:00", 1, 1.0), (2, "2024-01-01 10:10:00", 1, 2.0), (3, "2024-01-01 12:00:00", 1, 4.0), (4, "2024-01-01 10:05:00", 2, 8.0), (4, "2024-01-01 10:05:00", 2, 8.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_static_and_stream_agree(spark, tmp_path):
    static = _write(spark, str(tmp_path / "in"))
    want = {(r.user, str(r.window_start), r.n) for r in windowed(static, ["user"], {"n": F.count(F.lit(1))}).collect()}
    seen = []
    stream = windowed(read_stream(spark, str(tmp_path / "in"), SCHEMA), ["user"], {"n": F.count(F.lit(1))})
    run_available(stream, lambda batch, i: seen.append([(r.user, str(r.window_start), r.n) for r in batch.collect()]), str(tmp_path / "cp"), "complete")
    assert set(seen[-1]) == want == {(1, "2024-01-01 10:00:00", 2), (1, "2024-01-01 12:00:00", 1), (2, "2024-01-01 10:00:00", 2)}
    assert {(r.user, r.n) for r in sessions(static, ["user"], {"n": F.count(F.lit(1))}).collect()} == {(1, 2), (1, 1), (2, 2)}
    assert len({r.window_start for r in windowed(static, ["user"], {"n": F.count(F.lit(1))}, slide="30 minutes").collect()}) > 2
    assert deduplicated(static, ["event_id"]).count() == 4


def test_operators_on_a_stream_and_ingest(spark, tmp_path):
    _write(spark, str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), SCHEMA)
    names = Relation.from_rows(spark, [(1, "Ann"), (2, "Bob")], "user long, name string", "user", "users")
    db = Database({"events": Relation(stream, ("event_id",), "events"), "users": names})
    from loomset.operators.constraints import add_reference

    db = add_reference(db, source="events", ref_key="who", target="users", columns="user").result
    seen = []
    run_available(filter_values(db["events"], Eq("who.name", "Ann")).result.df, lambda b, i: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "cp"))
    assert sorted(seen) == [1, 2, 3]
    base = Database({"events": Relation(spark.createDataFrame([], SCHEMA), ("event_id",), "events")})
    path = str(tmp_path / "catalog")
    save(base, path)
    only = lambda n: read_stream(spark, str(tmp_path / "in"), SCHEMA).where(f"event_id <= {n}")
    ingest(spark, path, "events", deduplicated(only(2), ["event_id"]), str(tmp_path / "cp2"))
    first, number = current(spark, path)
    assert sorted(r.event_id for r in first["events"].df.collect()) == [1, 2]
    # A restart goes on from the stored version; a batch that comes again changes nothing.
    spark.createDataFrame([], SCHEMA).unionByName(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spark, path, "events", deduplicated(only(9), ["event_id"]), str(tmp_path / "cp2"))
    after, last = current(spark, path)
    assert {r.event_id for r in after["events"].df.collect()} >= {1, 2} and last > number
    commit(insert(after, "events", spark.createDataFrame([], SCHEMA)), path, last + 1)
    assert current(spark, path)[1] == last + 1 and len(current(spark, path)[0]["events"]) == len(after["events"])
