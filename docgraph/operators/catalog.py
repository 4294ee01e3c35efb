"""A catalog of collections: databases are folders, collections Parquet tables, metadata a log of small JSON objects.

``<root>/<db>/log/<n>.json`` names each collection's kind, indexes and the folders of its current rows; the highest
number holds, and a change creates the next number, which only one of two writers can do.  A collection's rows lie in
``<root>/<db>/<collection>/v<N>-<load>/bucket=<k>``, by a hash of the key, in layers: a load writes the rows it adds or changes,
and then the log, so readers see whole loads only, and a failed load leaves no trace.  Reading takes the latest row of a key; the
load that makes a bucket's layers more than ``MOST_LAYERS`` merges them.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.members import patched
from ..options import OptionError, parse_edge_definition
from ..scratch import discard, stored
from .export import delete, get, listed, publish, rename
from .upsert import MODES, patched_keys

KINDS = {"document": 2, "edge": 3}
SCHEMAS = {"document": "_key string, doc string", "edge": "_key string, _from string, _to string, doc string"}
BUCKETS = 8
LEASE_SECONDS = 600.0
MOST_LAYERS = 8  # of a bucket, before they are merged
NAME = re.compile(r"[A-Za-z0-9_-]{1,256}")


class CatalogError(ValueError):
    pass


class Database:
    def __init__(self, spark: SparkSession, root: str, name: str = "_system"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), _checked(name)
        self.folder = f"{self.root}/{self.name}"

    # Metadata

    def _read(self) -> tuple[int, dict]:
        """(highest number, newest metadata that can be read): an entry that is cut or empty counts for nothing."""
        for _ in range(10):
            numbers = sorted((int(n[:-5]) for n in listed(self.spark, f"{self.folder}/log") if n.endswith(".json")), reverse=True)
            if not numbers:
                return 0, {"collections": {}, "views": {}, "graphs": {}}
            for number in numbers:
                meta = self._entry_of_log(number)
                if meta is not None:
                    return numbers[0], meta
        raise CatalogError(f"the log of database '{self.name}' has no entry that can be read")

    def _entry_of_log(self, number: int) -> dict | None:
        try:
            entry = json.loads(get(self.spark, self._log(number)))
        except (ValueError, Py4JJavaError):  # torn, or deleted since the log was listed
            return None
        if not isinstance(entry, dict):
            return None
        if "meta" not in entry:
            return entry if "collections" in entry else None
        return entry["meta"] if entry.get("sha256") == _sum(entry["meta"]) else None

    def _meta(self) -> dict:
        return self._read()[1]

    def _log(self, number: int) -> str:
        return f"{self.folder}/log/{number:012d}.json"

    def _change(self, edit) -> dict:
        """Read, ``edit`` in place and publish as the next number; again from the start if another writer was first."""
        for _ in range(100):
            number, meta = self._read()
            edit(meta)
            entry = json.dumps({"meta": meta, "sha256": _sum(meta)}, indent=2, sort_keys=True)
            if publish(self.spark, self._log(number + 1), entry.encode()):
                if number > 20:
                    delete(self.spark, self._log(number - 20))
                return meta
        raise CatalogError("the catalog is being changed by others all the time")

    # Leases

    def lease(self, seconds: float = LEASE_SECONDS) -> "Lease":
        """A snapshot of all collections, whose files stay until it is released or has not been renewed for ``seconds``."""
        lease = Lease(self, uuid.uuid4().hex, seconds)
        lease.meta = self._change(lease._hold)
        return lease

    def _held(self, meta: dict) -> set[tuple[str, str, str]]:
        """(collection, folder, bucket) of what leases hold; those that have expired are dropped from ``meta``."""
        now = time.time()
        meta["leases"] = {k: v for k, v in meta.get("leases", {}).items() if v["until"] > now}
        return {(name, folder, bucket) for v in meta["leases"].values() for name, folders in v["folders"].items() for folder, bucket in folders}

    def _freed(self, meta: dict) -> list[list[str]]:
        """What was dropped and is held no more; it leaves ``meta``, and is to be deleted once that is published."""
        held = self._held(meta)
        dropped = meta.get("dropped", [])
        meta["dropped"] = [x for x in dropped if tuple(x) in held]
        return [x for x in dropped if tuple(x) not in held]

    def _delete(self, pieces: list) -> None:
        for name, folder, bucket in pieces:
            delete(self.spark, f"{self.folder}/{name}/{folder}/bucket={bucket}")

    def create(self) -> None:
        """Idempotent."""
        if not self._read()[0]:
            self._change(lambda meta: None)

    def drop(self) -> None:
        delete(self.spark, self.folder)

    # Collections

    def ensure_collection(self, name: str, kind: str = "document", buckets: int = BUCKETS) -> None:
        """Creates the collection, or fails if it exists with the other kind.  Large collections want more buckets."""
        _checked(name)

        def edit(meta: dict) -> None:
            known = meta["collections"].setdefault(name, _new_entry(kind, buckets))
            if known["kind"] != kind:
                raise CatalogError(f"collection '{name}' is of kind {known['kind']}, not {kind}")

        known = self._meta()["collections"].get(name)
        if known is None or known["kind"] != kind:
            self._change(edit)

    def drop_collection(self, name: str) -> None:
        """Idempotent; files that a lease holds go when it ends."""
        freed: list = []

        def edit(meta: dict) -> None:
            entry = meta["collections"].pop(_checked(name), None)
            if entry:
                meta.setdefault("dropped", []).extend([name, f, k] for f, k in [*_pieces(entry), *entry["retired"]])
            freed[:] = self._freed(meta)

        meta = self._change(edit)
        self._delete(freed)
        if name not in meta["collections"] and not any(x[0] == name for x in meta["dropped"]):
            delete(self.spark, f"{self.folder}/{name}")

    def create_index(self, name: str, definition: dict) -> None:
        self._entry(name)
        self._change(lambda meta: meta["collections"][name]["indexes"].append(definition))

    def drop_index(self, name: str, definition: dict) -> None:
        """Idempotent."""
        self._entry(name)

        def edit(meta: dict) -> None:
            entry = meta["collections"][name]
            entry["indexes"] = [x for x in entry["indexes"] if x != definition]

        self._change(edit)

    def read(self, name: str, entry: dict | None = None) -> DataFrame:
        """The collection's current rows, or those of an ``entry`` kept from before.  The name is looked up, never made part of a statement."""
        entry = entry or self._entry(name)
        return self._rows(name, entry, entry["folders"])

    def _rows(self, name: str, entry: dict, buckets) -> DataFrame:
        """Rows of some buckets, of all their layers; of a key that a later layer has again, the later row."""
        schema = SCHEMAS[entry["kind"]]
        layers = [(f, over, f"{self.folder}/{name}/{f}/bucket={k}") for k in buckets for f, over in entry["folders"].get(k, [])]
        if not layers:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        if not any(over for _, over, _ in layers):
            return reader.parquet(*[path for *_, path in layers])
        version = F.regexp_extract("_metadata.file_path", r".*/v(\d+)-[^/]*/bucket=", 1).cast("long").alias("version")
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = reader.parquet(*[path for *_, path in layers]).select(*columns, version)
        again = reader.parquet(*[path for _, over, path in layers if over]).select("_key", version).groupBy("_key").agg(F.max("version").alias("last"))
        return rows.join(again, "_key", "left").where("last IS NULL OR version >= last").select(*columns)

    def _keys(self, name: str, entry: dict, buckets) -> DataFrame:
        """The keys of some buckets, for which layers over each other make no difference."""
        paths = [f"{self.folder}/{name}/{f}/bucket={k}" for k in buckets for f, _ in entry["folders"].get(k, [])]
        schema = SCHEMAS[entry["kind"]]
        keys = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        several = any(over for k in buckets for _, over in entry["folders"].get(k, []))
        return keys.select("_key").distinct() if several else keys.select("_key")

    def _entry(self, name: str) -> dict:
        entry = self._meta()["collections"].get(name)
        if entry is None:
            raise CatalogError(f"no collection '{name}'")
        return entry

    def count(self, name: str) -> int:
        return self.read(name).count()

    def load(
        self, name: str, rows: DataFrame, mode: str = "error", order: list[str] | None = None,
        overwrite: bool = False, complete: bool = False, load_id: str | None = None, details: bool = False,
        progress: tuple[str, int] | None = None,
    ) -> dict:
        """Load rows: the collection's columns, and those of ``order`` (by default ``ordinal``, which must be there).

        Returns created, updated, ignored and errors.  A row without a key gets one of its own, from ``load_id``
        (by default a new one) and the row's number.  ``overwrite`` empties the collection once, before the load;
        ``complete`` refuses the whole load if it has errors; ``details`` stores the refused rows and returns their folder as ``refused``;
        ``progress`` (an import's name, what it has done) is published with the rows or not at all.  Of two loads of one collection at once, the second fails.
        """
        if mode not in MODES:
            raise CatalogError(f"unknown duplicate mode '{mode}'; known: {', '.join(MODES)}")
        entry = self._entry(name)
        order = order or ["ordinal"]
        missing = [c for c in order if c not in rows.columns]
        if missing:
            raise CatalogError(f"a load needs its order; there is no column '{missing[0]}'")
        columns = [c.split()[0] for c in SCHEMAS[entry["kind"]].split(", ")]
        load_id = load_id or uuid.uuid4().hex
        folder = f"v{entry['version'] + 1}-{load_id[:16]}"
        path, staged = f"{self.folder}/{name}/{folder}", f"{self.folder}/{name}/{folder}.rows"
        orders = [F.col(f"`{c}`").alias(f"order{i}") for i, c in enumerate(order)]
        kept = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
        seen = Observation()
        given = F.coalesce("_key", F.concat(F.lit(f"{load_id[:16]}-"), F.col("row").cast("string")))
        numbered = rows.select(*kept, *orders, F.monotonically_increasing_id().alias("row")).withColumn("_key", given).withColumn("bucket", _bucket(entry["buckets"]))
        numbered.observe(seen, F.collect_set("bucket").alias("buckets")).write.mode("overwrite").parquet(staged)
        incoming = self.spark.read.schema(numbered.schema).parquet(staged)
        touched = [str(k) for k in _seen(seen, incoming, F.collect_set("bucket").alias("buckets"))["buckets"]]  # at most the number of buckets
        ordered = [*[f"order{i}" for i in range(len(order))], "row"]
        base = {**entry, "folders": {}} if overwrite else entry
        counts, over = self._write_layer(name, base, incoming, touched, ordered, mode, path)
        if details:
            counts["refused"] = self._refused(name, base, incoming, touched, ordered, order, mode, f"{self.folder}/{name}/refused-{load_id}")
        if complete and counts["errors"]:
            delete(self.spark, staged)
            delete(self.spark, path)
            raise CatalogError(f"{counts['errors']} rows have a key that exists; nothing was loaded")
        written = {n.partition("=")[2] for n in listed(self.spark, path) if n.startswith("bucket=")}
        layers = {k: [*base["folders"].get(k, []), [folder, over]] for k in written}
        full = [k for k, found in layers.items() if len(found) > MOST_LAYERS]
        if full:
            merged = self._rows(name, {**entry, "folders": layers}, full).withColumn("bucket", _bucket(entry["buckets"]))
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}m")
            layers |= {k: [[f"{folder}m", False]] for k in full}

        def publish(meta: dict) -> None:
            now = meta["collections"].get(name)
            if now is None or now["version"] != entry["version"]:
                raise CatalogError(f"collection '{name}' was changed by another load")
            old = now["folders"]
            fresh = {} if overwrite else dict(old)
            fresh |= layers
            held = self._held(meta)
            retired = [tuple(x) for x in now["retired"]]
            freed[:] = [*self._freed(meta), *([name, *x] for x in retired if (name, *x) not in held)]
            # Readers may still have open what this load replaces; the next one deletes it, if no lease holds it.
            now["retired"] = [list(x) for x in retired if (name, *x) in held] + [[f, k] for f, k in _pieces({"folders": old}) if f not in [x for x, _ in fresh.get(k, [])]]
            now["retired"] += [[folder, k] for k in full]  # merged at once
            now["version"], now["folders"] = entry["version"] + 1, fresh
            if progress:
                now.setdefault("progress", {})[progress[0]] = progress[1]

        freed: list = []
        try:
            self._change(publish)
        except CatalogError:
            delete(self.spark, path)
            delete(self.spark, f"{path}m")
            raise
        finally:
            delete(self.spark, staged)
        self._delete(freed)
        return counts

    def _write_layer(self, name: str, base: dict, incoming: DataFrame, touched: list[str], ordered: list[str], mode: str, path: str) -> tuple[dict, bool]:
        """Write what a load adds or changes, and only that; returns the counts, and whether keys of before are among it."""
        columns = [c.split()[0] for c in SCHEMAS[base["kind"]].split(", ")]
        old = self._keys(name, base, touched).select("_key", F.lit(True).alias("old"))
        seen, more, buckets = Observation(), {}, base["buckets"]
        if mode == "update":
            again = stored(incoming.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
            single = incoming.join(again, "_key", "left_anti") if not again.isEmpty() else incoming
            before = self._rows(name, base, touched)
            late = [c for c in columns if c not in ("_key", "doc")]
            was = before.select("_key", F.col("doc").alias("old_doc"), F.lit(True).alias("old"), *[F.col(c).alias(f"old_{c}") for c in late])
            met = single.join(was, "_key", "left").withColumn("n", F.lit(1))
            keys = met
            met = _counted(met, seen).select("_key", *[F.coalesce(c, f"old_{c}").alias(c) for c in late], "old_doc", F.col("doc").alias("new_doc"))
            after = patched(met, "old_doc", "new_doc").select(*columns)
            if not again.isEmpty():
                several = incoming.join(again.select("_key"), "_key", "left_semi")
                after = after.unionByName(patched_keys(before.join(again.select("_key"), "_key", "left_semi"), several, ordered).select(*columns))
                more = _of(again.join(old, "_key", "left"))
        else:
            row = F.struct(*ordered, *[c for c in columns if c != "_key"])
            picked = (F.max if mode == "replace" else F.min)(row).alias("picked")
            met = incoming.groupBy("bucket", "_key").agg(picked, F.count("*").alias("n")).join(old, "_key", "left")
            keys, after = met, _counted(met, seen)
            after = after if mode == "replace" else after.where("old IS NULL")
            after = after.select(*["_key" if c == "_key" else f"picked.{c}" for c in columns])
        after.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        found = _seen(seen, keys, *_measures())
        total = {k: (found[k] or 0) + (more.get(k) or 0) for k in ("created", "repeats", "known")}
        if mode == "update":
            discard(again)
        counts = {"created": total["created"], "updated": 0, "ignored": 0, "errors": 0}
        counts[{"error": "errors", "ignore": "ignored"}.get(mode, "updated")] = total["repeats"]
        return counts, bool(total["known"]) and mode in ("replace", "update")

    def _refused(self, name: str, base: dict, incoming: DataFrame, touched: list[str], ordered: list[str], order: list[str], mode: str, path: str) -> str:
        """Folder of the rows that the load left out: their order, key and the reason."""
        first = incoming.groupBy("_key").agg(F.min(F.struct(*ordered)).alias("first"))
        old = self._keys(name, base, touched).select("_key", F.lit(True).alias("old"))
        marked = incoming.join(first, "_key").join(old, "_key", "left")
        out = marked.where(F.col("old") | (F.struct(*ordered) != F.col("first"))) if mode in ("error", "ignore") else marked.where("false")
        reason = F.when(F.col("old"), "the collection has the key").otherwise("an earlier row has the key")
        out.select(*[F.col(f"order{i}").alias(c) for i, c in enumerate(order)], "_key", reason.alias("reason")).write.mode("overwrite").parquet(path)
        return path

    def progress(self, name: str, mark: str) -> int:
        """What the import ``mark`` has done of its work on this collection; 0 if nothing."""
        return self._entry(name).get("progress", {}).get(mark, 0)

    def load_many(self, rows: DataFrame, kind: str, mode: str = "ignore", order: list[str] | None = None) -> dict:
        """Load rows of many collections (``collection`` and that kind's columns) in a fixed number of jobs and one change of the log.

        Missing collections are created.  ``mode`` is error, ignore or replace; returns the counts over all collections.
        """
        if mode not in MODES or mode == "update":
            raise CatalogError(f"many collections are loaded by error, ignore or replace, not '{mode}'")
        order = order or ["_key"]
        columns = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
        load_id = uuid.uuid4().hex
        staged, path = f"{self.folder}/loads-{load_id}.rows", f"{self.folder}/loads-{load_id}"
        seen = Observation()
        orders = [F.col(f"`{c}`").alias(f"order{i}") for i, c in enumerate(order)]
        numbered = rows.select("collection", *columns, *orders, F.monotonically_increasing_id().alias("row"))
        numbered.observe(seen, F.collect_set("collection").alias("names")).write.parquet(staged)
        incoming = self.spark.read.schema(numbered.schema).parquet(staged)
        names = sorted(_seen(seen, incoming, F.collect_set("collection").alias("names"))["names"])  # the catalog's log lists every collection anyway
        for n in names:
            _checked(n)

        def ensure(meta: dict) -> None:
            for n in names:
                known = meta["collections"].setdefault(n, _new_entry(kind, BUCKETS))
                if known["kind"] != kind:
                    raise CatalogError(f"collection '{n}' is of kind {known['kind']}, not {kind}")

        entries = self._change(ensure)["collections"]
        counted = self.spark.createDataFrame([(n, entries[n]["buckets"]) for n in names], "collection string, buckets int")
        incoming = incoming.join(counted, "collection")
        incoming = incoming.withColumn("bucket", F.pmod(F.xxhash64("_key"), F.col("buckets")).cast("int"))
        paths = [f"{self.folder}/{n}/{f}" for n in names for f in sorted({f for f, _ in _pieces(entries[n])})]
        live = {f"{n}/{f}/bucket={k}" for n in names for f, k in _pieces(entries[n])}
        old = self.spark.createDataFrame([], "collection string, _key string")
        if paths:
            found = self.spark.read.schema(SCHEMAS[kind]).option("recursiveFileLookup", "true").parquet(*paths)
            piece = F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+/bucket=[0-9]+)/[^/]*$", 1)
            known = self.spark.createDataFrame([(x,) for x in sorted(live)], "piece string")
            found = found.select("_key", piece.alias("piece")).join(known, "piece", "left_semi")
            old = found.select(F.substring_index("piece", "/", 1).alias("collection"), "_key").distinct()
        picked = (F.max if mode == "replace" else F.min)(F.struct(*[f"order{i}" for i in range(len(order))], "row", *[c for c in columns if c != "_key"])).alias("picked")
        met = incoming.groupBy("collection", "bucket", "_key").agg(picked, F.count("*").alias("n")).join(old.withColumn("old", F.lit(True)), ["collection", "_key"], "left")
        done = Observation()
        after = _counted(met, done)
        after = after if mode == "replace" else after.where("old IS NULL")
        after.select(*["_key" if c == "_key" else f"picked.{c}" for c in columns], "collection", "bucket").hint("rebalance", "collection", "bucket").write.partitionBy("collection", "bucket").parquet(path)
        total = _seen(done, met, *_measures())
        counts = {"created": total["created"] or 0, "updated": 0, "ignored": 0, "errors": 0}
        counts[{"error": "errors", "ignore": "ignored"}.get(mode, "updated")] = total["repeats"] or 0
        layers: dict[str, dict[str, list]] = {}
        for n in names:
            folder = f"v{entries[n]['version'] + 1}-{load_id[:16]}"
            if rename(self.spark, f"{path}/collection={n}", f"{self.folder}/{n}/{folder}"):
                buckets = [x.partition("=")[2] for x in listed(self.spark, f"{self.folder}/{n}/{folder}") if x.startswith("bucket=")]
                layers[n] = {k: [folder, mode == "replace"] for k in buckets}

        def publish(meta: dict) -> None:
            for n, fresh in layers.items():
                now = meta["collections"].get(n)
                if now is None or now["version"] != entries[n]["version"]:
                    raise CatalogError(f"collection '{n}' was changed by another load")
                for k, layer in fresh.items():
                    now["folders"].setdefault(k, []).append(layer)
                now["version"] += 1

        try:
            self._change(publish)
        except CatalogError:
            for n, fresh in layers.items():
                for folder in {f for f, _ in fresh.values()}:
                    delete(self.spark, f"{self.folder}/{n}/{folder}")
            raise
        finally:
            delete(self.spark, staged)
            delete(self.spark, path)
        return counts

    def inventory(self, include_system: bool = False, include: str | None = None, exclude: str | None = None, meta: dict | None = None) -> DataFrame:
        """(name, kind, is_system, version) of the collections that the filter lets pass."""
        rows = [(n, e["kind"], is_system(n, e["properties"]), e["version"]) for n, e in (meta or self._meta())["collections"].items()]
        df = self.spark.createDataFrame(rows, "name string, kind string, is_system boolean, version long")
        return filter_collections(df, include_system, include, exclude)

    def query(self, statement: str, args: dict | None = None) -> DataFrame:
        """Spark SQL over the collections as views; values are bound, never pasted in."""
        for name in self._meta()["collections"]:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(statement, args=args)

    # Views and graphs

    def create_view(self, name: str, definition: dict) -> None:
        kept = {k: v for k, v in definition.items() if k not in ("id", "globallyUniqueId")}
        self._change(lambda meta: meta["views"].update({_checked(name): kept}))

    def views(self) -> dict:
        return self._meta()["views"]

    def create_graph(self, name: str, definitions: list[str] = (), orphans: list[str] = ()) -> dict:
        """A named graph; its missing collections are created."""
        if not definitions and not orphans:
            raise OptionError("a graph needs an edge definition or an orphan collection")
        parsed = [parse_edge_definition(d) for d in definitions]
        for d in parsed:
            self.ensure_collection(d["collection"], "edge")
            for vertex in [*d["from"], *d["to"]]:
                self.ensure_collection(vertex)
        for vertex in orphans:
            self.ensure_collection(vertex)
        graph = {"edgeDefinitions": parsed, "orphanCollections": list(orphans)}
        self._change(lambda meta: meta["graphs"].update({_checked(name): graph}))
        return graph

    def drop_graph(self, name: str, drop_collections: bool = False) -> None:
        """Idempotent."""
        graph = self._meta()["graphs"].get(name)
        self._change(lambda meta: meta["graphs"].pop(name, None))
        if graph and drop_collections:
            for d in graph["edgeDefinitions"]:
                for c in [d["collection"], *d["from"], *d["to"]]:
                    self.drop_collection(c)
            for c in graph["orphanCollections"]:
                self.drop_collection(c)


class Lease:
    """A snapshot whose files no load deletes.  Renew it while it is in use, and release it afterwards."""

    def __init__(self, db: Database, id: str, seconds: float):
        self.db, self.id, self.seconds, self.meta, self._done = db, id, seconds, {}, threading.Event()

    def _hold(self, meta: dict) -> None:
        self.db._held(meta)
        known = meta["leases"].get(self.id, {}).get("folders")
        folders = known or {name: [list(x) for x in _pieces(e)] for name, e in meta["collections"].items()}
        meta["leases"][self.id] = {"until": time.time() + self.seconds, "folders": folders}

    def renew(self) -> None:
        def edit(meta: dict) -> None:
            if self.id not in meta.get("leases", {}):
                raise CatalogError("the lease has expired")
            self._hold(meta)

        self.db._change(edit)

    def release(self) -> None:
        """Idempotent."""
        self._done.set()
        freed: list = []

        def edit(meta: dict) -> None:
            meta.setdefault("leases", {}).pop(self.id, None)
            freed[:] = self.db._freed(meta)

        self.db._change(edit)
        self.db._delete(freed)

    def __enter__(self) -> "Lease":
        """Renews itself until it is released."""

        def keep() -> None:
            while not self._done.wait(self.seconds / 3):
                self.renew()

        threading.Thread(target=keep, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _new_entry(kind: str, buckets: int) -> dict:
    return {"kind": kind, "version": 0, "buckets": buckets, "folders": {}, "retired": [], "indexes": [], "properties": {}}


def _pieces(entry: dict) -> list[tuple[str, str]]:
    return [(folder, bucket) for bucket, layers in entry["folders"].items() for folder, _ in layers]


def _measures() -> list[Column]:
    """Of rows (n, old), one for each key: keys that are new, rows besides those, and keys that were there."""
    repeats = F.sum(F.col("n") - F.when(F.col("old").isNull(), 1).otherwise(0))
    return [F.count_if(F.col("old").isNull()).alias("created"), repeats.alias("repeats"), F.count_if(F.col("old")).alias("known")]


def _seen(seen: Observation, rows: DataFrame, *measures: Column) -> dict:
    """What was observed while ``rows`` were written, or, where nothing was and the plan ended as an empty one, what they measure."""
    try:
        return seen.get
    except Py4JJavaError:
        return rows.agg(*measures).first().asDict()


def _counted(keys: DataFrame, seen: Observation) -> DataFrame:
    return keys.observe(seen, *_measures())


def _of(keys: DataFrame) -> dict:
    return keys.agg(*_measures()).first().asDict()


def _sum(meta: dict) -> str:
    return hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()


def _bucket(count: int) -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(count)).cast("int")


def _checked(name: str) -> str:
    if not NAME.fullmatch(name):
        raise CatalogError(f"invalid name '{name}'")
    return name


def is_system(name: str, properties: dict | None = None) -> bool:
    return (properties or {}).get("isSystem", name.startswith("_"))


def filter_collections(df: DataFrame, include_system: bool = False, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Include and not exclude, both searched anywhere in the name; system collections pass by ``include_system`` alone."""
    passes = F.lit(True)
    if include:
        passes = passes & F.col("name").rlike(include)
    if exclude:
        passes = passes & ~F.col("name").rlike(exclude)
    return df.where(F.when(F.col("is_system"), F.lit(include_system)).otherwise(passes))


def view_targets(view: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(name, target) of each collection a view rests on: the keys of ``links`` and the collections of ``indexes``."""
    links = view.select("name", F.explode(F.map_keys(F.from_json(F.get_json_object(doc_col, "$.links"), "map<string,string>"))).alias("target"))
    listed = view.select("name", F.explode(F.from_json(F.get_json_object(doc_col, "$.indexes"), "array<struct<collection:string>>")).alias("i")).select("name", F.col("i.collection").alias("target"))
    return links.unionByName(listed).where("target IS NOT NULL").distinct()


def complete_views(view: DataFrame, collections: DataFrame) -> DataFrame:
    """Views whose every target is among the collections; a view of unknown shape has no targets and stays."""
    missing = view_targets(view).join(collections.select(F.col("name").alias("target")), "target", "left_anti").select("name").distinct()
    return view.join(missing, "name", "left_anti")
