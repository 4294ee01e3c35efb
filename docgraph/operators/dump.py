"""Dump and restore of a catalog's databases, as files that a manifest describes."""

from __future__ import annotations

import json
from contextlib import ExitStack
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import json_string
from .catalog import LEASE_SECONDS, Database, complete_views
from .export import MANIFEST_VERSION, Parts, delete, encode_parts, exists, get, put, read_parts, relative, store_parts

MARKER = 2300
CLAIM, MANIFEST = "dump.in-progress.json", "dump.manifest.json"


class DumpError(ValueError):
    pass


def claim(spark: SparkSession, folder: str, overwrite: bool = False) -> None:
    """One dump per folder: refuses a finished dump, and one that another run has begun."""
    if overwrite:
        delete(spark, f"{folder}/{CLAIM}")
        delete(spark, f"{folder}/{MANIFEST}")
    if exists(spark, f"{folder}/{MANIFEST}"):
        raise DumpError(f"'{folder}' holds a finished dump")
    if not put(spark, f"{folder}/{CLAIM}", json.dumps({"started": _now()}).encode(), overwrite=False):
        raise DumpError(f"'{folder}' is claimed by a dump in progress")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def with_reserved(df: DataFrame) -> DataFrame:
    """Documents that say their own key and ends: what a row's columns hold and its text lacks is put in front."""
    for name in ("_to", "_from", "_key"):
        if name in df.columns:
            rest = F.substring("doc", F.lit(2), F.length("doc"))
            comma = F.when(rest.rlike(r"\A\s*\}"), "").otherwise(",")
            named = F.concat(F.lit(f'{{"{name}":'), json_string(F.col(name)), comma, rest)
            df = df.withColumn("doc", F.when(F.get_json_object("doc", f"$.{name}").isNull() & F.col(name).isNotNull(), named).otherwise(F.col("doc")))
    return df


def enveloped(df: DataFrame) -> DataFrame:
    return df.withColumn("doc", F.concat(F.lit(f'{{"type":{MARKER},"data":'), F.col("doc"), F.lit("}")))


def unwrapped(df: DataFrame) -> DataFrame:
    head = len(f'{{"type":{MARKER},"data":') + 1
    return df.withColumn("doc", F.substring("doc", F.lit(head), F.length("doc") - F.lit(head)))


def dump_database(db: Database, folder: str, meta: dict, prefix: str = "", database: str | None = None, include: str | None = None, exclude: str | None = None, include_system: bool = False, codec: str | None = None) -> list[dict]:
    """Artifacts of one database: structure, data and views, as its metadata ``meta`` had them."""
    spark, artifacts, done = db.spark, [], []
    tag = {"database": database} if database else {}
    for row in db.inventory(include_system, include, exclude, meta).orderBy("name").collect():
        entry = meta["collections"][row.name]
        structure = {"parameters": {"name": row.name, "type": {"document": 2, "edge": 3}[row.kind], **entry["properties"]}, "indexes": entry["indexes"]}
        path = f"{prefix}{row.name}.structure.json"
        put(spark, f"{folder}/{path}", json.dumps(structure, indent=2).encode())
        artifacts.append({"kind": "structure", "path": path, "collection": row.name, "encryption": "none", **tag})
        rows = enveloped(with_reserved(db.read(row.name, entry))).select(F.col("_key").alias("ordinal"), "doc")
        parts = encode_parts(rows, f"{prefix}{row.name}.data", codec=codec)
        artifacts += [{**a, "collection": row.name, **tag} for a in _stored(parts, folder)]
        done.append(row.name)
    views = meta["views"]
    if views:
        table = spark.createDataFrame([(n, json.dumps(v)) for n, v in views.items()], "name string, doc string")
        names = spark.createDataFrame([(n,) for n in done], "name string")
        for row in complete_views(table, names).orderBy("name").collect():
            path = f"{prefix}{row.name}.view.json"
            put(spark, f"{folder}/{path}", json.dumps(views[row.name], indent=2).encode())
            artifacts.append({"kind": "view", "path": path, "view": row.name, "encryption": "none", **tag})
    return artifacts


def views_left_out(db: Database, include: str | None = None, exclude: str | None = None, include_system: bool = False) -> list[str]:
    """Names of the views of which a dump with these filters lacks a collection."""
    views = db.views()
    if not views:
        return []
    table = db.spark.createDataFrame([(n, json.dumps(v)) for n, v in views.items()], "name string, doc string")
    kept = {r.name for r in complete_views(table, db.inventory(include_system, include, exclude).select("name")).collect()}
    return sorted(set(views) - kept)


def _stored(parts: Parts, folder: str) -> list[dict]:
    """Writes parts and describes them, in order; no rows is no data artifact."""
    return [
        {"kind": "data", **{k: r[k] for k in ("path", "format", "compression", "part", "byte_size")}, "encryption": "none", "checksum": {"algorithm": "sha256", "value": r["sha256"]}}
        for r in store_parts(parts, folder)
    ]


def dump(databases: list[Database], folder: str, overwrite: bool = False, all_databases: bool = False, lease_seconds: float = LEASE_SECONDS, **filters) -> dict:
    """Dumps databases and writes the manifest last; the claim is given back only on success.

    A lease on every database is taken at the start and renewed until the end, so every collection is dumped as it was then,
    however many loads come meanwhile; that of a dump that died expires after ``lease_seconds``.
    """
    spark = databases[0].spark
    claim(spark, folder, overwrite)
    artifacts = []
    with ExitStack() as leases:
        snapshot = [leases.enter_context(db.lease(lease_seconds)).meta for db in databases]
        for db, meta in zip(databases, snapshot):
            prefix = f"databases/{db.name}/" if all_databases else ""
            artifacts += dump_database(db, folder, meta, prefix, db.name if all_databases else None, **filters)
    manifest = {"manifest_version": MANIFEST_VERSION, "database": "all" if all_databases else databases[0].name, "created_at": _now(), "artifacts": artifacts}
    put(spark, f"{folder}/{MANIFEST}", json.dumps(manifest, indent=2).encode())
    delete(spark, f"{folder}/{CLAIM}")
    return manifest


def fingerprint(manifest: dict) -> str:
    return f"{manifest['database']}|{manifest['created_at']}|" + "".join(f"{a['path']}," for a in manifest["artifacts"])


def check_manifest(manifest: dict) -> None:
    if manifest.get("manifest_version") != MANIFEST_VERSION:
        raise DumpError(f"unknown manifest version {manifest.get('manifest_version')!r}")
    for a in manifest["artifacts"]:
        if a.get("encryption", "none") != "none":
            raise DumpError(f"'{a['path']}' is encrypted")
        if a["kind"] == "data" and a.get("format") == "vpack":
            raise DumpError(f"'{a['path']}' is in a binary format that is not supported")


def restore_units(artifacts: DataFrame) -> DataFrame:
    """(database, collection, position): databases by first appearance, documents before edges, then as listed.

    ``artifacts``: position, database, collection, is_edge.
    """
    units = artifacts.groupBy("database", "collection").agg(F.min("position").alias("position"), F.max("is_edge").alias("is_edge"))
    first = artifacts.groupBy("database").agg(F.min("position").alias("database_position"))
    return units.join(F.broadcast(first), "database").orderBy("database_position", "is_edge", "position")


def unit_id(database: str, name: str, view: bool = False) -> str:
    return f"{database}::view::{name}" if view else f"{database}::{name}"


def restore(spark: SparkSession, root: str, folder: str, database: str | None = None, checkpoint: str | None = None, mode: str = "replace") -> list[str]:
    """Restores a dump in four phases: collections, search views, data with indexes, alias views.

    With a checkpoint path, finished units are skipped, and a checkpoint of another
    dump is refused.  Returns the units restored now.
    """
    manifest = json.loads(get(spark, f"{folder}/{MANIFEST}"))
    check_manifest(manifest)
    mark = fingerprint(manifest)
    state = {"fingerprint": mark, "done": []}
    if checkpoint and exists(spark, checkpoint):
        state = json.loads(get(spark, checkpoint))
        if state["fingerprint"] != mark:
            raise DumpError("the checkpoint belongs to another dump")
    structures, rows, restored = {}, [], []
    name_of = lambda a: database or a.get("database") or manifest["database"]
    for position, a in enumerate(manifest["artifacts"]):
        if a["kind"] == "structure":
            body = json.loads(get(spark, f"{folder}/{relative(a['path'])}"))
            structures[name_of(a), a["collection"]] = body
            rows.append((position, name_of(a), a["collection"], body["parameters"]["type"] == 3))
    units = restore_units(spark.createDataFrame(rows, "position int, database string, collection string, is_edge boolean")).collect() if rows else []

    def finish(unit: str) -> None:
        state["done"].append(unit)
        restored.append(unit)
        if checkpoint:
            put(spark, checkpoint, json.dumps(state).encode())

    def views(alias: bool) -> None:
        for a in manifest["artifacts"]:
            unit = unit_id(name_of(a), a.get("view", ""), view=True)
            if a["kind"] == "view" and unit not in state["done"]:
                body = json.loads(get(spark, f"{folder}/{relative(a['path'])}"))
                if (body.get("type") == "search-alias") == alias:
                    Database(spark, root, name_of(a)).create_view(a["view"], body)
                    finish(unit)

    pending = [u for u in units if unit_id(u.database, u.collection) not in state["done"]]
    for u in pending:
        Database(spark, root, u.database).ensure_collection(u.collection, "edge" if u.is_edge else "document")
    views(alias=False)
    for u in pending:
        db = Database(spark, root, u.database)
        data = [a for a in manifest["artifacts"] if a["kind"] == "data" and name_of(a) == u.database and a["collection"] == u.collection]
        if data:
            docs = unwrapped(read_parts(spark, folder, {"artifacts": data})).select("part", "ordinal", F.get_json_object("doc", "$._key").alias("_key"), *([F.get_json_object("doc", "$._from").alias("_from"), F.get_json_object("doc", "$._to").alias("_to")] if u.is_edge else []), "doc")
            db.load(u.collection, docs, mode, order=["part", "ordinal"])
        for index in structures[u.database, u.collection]["indexes"]:
            if index.get("type") not in ("primary", "edge"):
                db.create_index(u.collection, index)
        finish(unit_id(u.database, u.collection))
    views(alias=True)
    return restored
