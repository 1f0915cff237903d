"""A store for databases: one Parquet table for each relation and a JSON manifest for keys and references.

The manifest is read and written with Spark, so a catalog can lie wherever Spark can.  It is plain JSON; loading one runs no code.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..model import Database, Reference, Relation

MANIFEST = "manifest"


def save(database: Database, path: str, mode: str = "errorifexists") -> None:
    """Write all relations, computed attributes and default items as stored ones."""
    spark = None
    for name, relation in database.bound().items():
        spark = relation.df.sparkSession
        relation.items().write.mode(mode).parquet(f"{path}/{name}")
    if spark is None:
        raise ValueError("an empty database is not stored")
    manifest = {
        "version": 1,
        "name": database.name,
        "relations": [{"name": n, "key": list(r.key)} for n, r in database.bound().items()],
        "references": [{"source": r.source, "ref_key": r.ref_key, "columns": list(r.columns), "target": r.target, "key": list(r.key)} for r in database.references],
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/{MANIFEST}")


def load(spark: SparkSession, path: str) -> Database:
    """The database of a catalog; relations are read when they are used, with filters and columns pushed into the scan."""
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first().value)
    if manifest["version"] != 1:
        raise ValueError(f"catalog version {manifest['version']!r} is not 1")
    relations = {r["name"]: Relation(spark.read.parquet(f"{path}/{r['name']}"), tuple(r["key"]), r["name"]) for r in manifest["relations"]}
    references = tuple(Reference(r["source"], r["ref_key"], tuple(r["columns"]), r["target"], tuple(r["key"])) for r in manifest["references"])
    return Database(relations, references, name=manifest["name"])


def current(spark: SparkSession, path: str) -> tuple[Database, int | None]:
    """The newest whole version of a catalog and its number; the catalog as first saved has none.

    The manifest is written last, so a version that has one is whole.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-*/{MANIFEST}/_SUCCESS")) or []
    numbers = [int(f.getPath().getParent().getParent().getName().removeprefix("version-")) for f in found]
    return (load(spark, f"{path}/version-{max(numbers)}"), max(numbers)) if numbers else (load(spark, path), None)


def commit(database: Database, path: str, number: int) -> None:
    """Write a version; one that was interrupted is written anew."""
    save(database, f"{path}/version-{number}", "overwrite")


def read(spark: SparkSession, path: str, key: str | tuple[str, ...], name: str | None = None, format: str = "parquet", schema: str | None = None, **options: str) -> Relation:
    """A relation over files of any format Spark reads."""
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    return Relation(df, (key,) if isinstance(key, str) else tuple(key), name)


def unique_keys(relation: Relation) -> bool:
    """Whether no key comes twice; one aggregation."""
    from pyspark.sql import functions as F

    return not relation.df.groupBy(*relation.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
