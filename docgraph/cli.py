"""Command line: import, export, dump, restore, rdf and graph over a catalog folder.

Results are one JSON object on standard output; progress and errors are JSON lines
on standard error; the exit code is 0, 1 for rows that were refused, or 2 for an error.
Query texts and bound values are never echoed.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Observation
from pyspark.sql import functions as F

from .operators import dump as dumps
from .operators import export, rdf_graph
from .operators.catalog import Database
from .operators.edges import preflight
from .operators.export import listed, put
from .operators.resume import load_in_steps
from .operators.reshape import refuse_reshape, to_documents, typed_cells
from .options import OptionError, Reshape, infer_codec, infer_document_format, infer_rdf_format, redacted, spark_path
from .scratch import new_folder
from .sources.documents import PLACE, first_bad_line, read_delimited, read_json_array, read_jsonl
from .sources.rdf_lines import read_statements
from .sources.turtle import read_turtle


def event(kind: str, **fields) -> None:
    print(json.dumps({"event": kind, **fields}), file=sys.stderr, flush=True)


@contextmanager
def progress(spark: SparkSession, seconds: float):
    """A progress event every ``seconds``, and one at the end: tasks done and bytes read by this command so far, over all executors."""
    def totals() -> dict[str, int]:
        found = spark._jsc.sc().statusStore().executorList(False)
        each = [found.apply(k) for k in range(found.size())]
        return {"tasks": sum(x.completedTasks() for x in each), "bytes_read": sum(x.totalInputBytes() for x in each), "bytes_shuffled": sum(x.totalShuffleWrite() for x in each)}

    before, began, done = totals(), time.time(), threading.Event()

    def tell() -> None:
        event("progress", seconds=round(time.time() - began, 1), **{k: v - before[k] for k, v in totals().items()})

    def keep() -> None:
        while not done.wait(seconds):
            tell()

    thread = threading.Thread(target=keep, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        tell()


def read_documents(spark: SparkSession, path: str, kind: str | None, options: Reshape) -> DataFrame:
    kind = kind or infer_document_format(path)
    refuse_reshape(kind, options)
    path = spark_path(path)
    if kind == "jsonl":
        return read_jsonl(spark, path, place=True)
    if kind == "json":
        return read_json_array(spark, path, place=True).select("doc", *PLACE)
    rows = read_delimited(spark, path, "\t" if kind == "tsv" else ",", place=True)
    place = rows.columns[-1]
    return to_documents(typed_cells(rows, options, carry=place), carry=place).select("doc", *[F.col(f"{place}.{c}").alias(c) for c in PLACE])


def spooled(spark: SparkSession, kind: str | None) -> str:
    """Standard input, copied in pieces to the shared folder."""
    if not kind:
        raise OptionError("standard input needs a format")
    path = f"{new_folder(spark, 'stdin')}.{kind}"
    put(spark, path, iter(lambda: sys.stdin.buffer.read(1 << 20), b""))
    return path


def import_documents(spark: SparkSession, db: Database, a: argparse.Namespace) -> dict:
    options = Reshape(tuple(a.datatype), tuple(a.translate), tuple(a.merge_attributes), tuple(a.remove_attribute))
    docs = read_documents(spark, spooled(spark, a.format) if a.input == "-" else a.input, a.format, options)
    docs = docs.withColumn("_key", F.get_json_object("doc", "$._key"))
    db.ensure_collection(a.collection, "edge" if a.edges else "document")
    seen = None
    if a.edges:
        seen = Observation()
        ends = docs.select("*", *[F.get_json_object("doc", f"$.{e}").alias(e) for e in ("_from", "_to")])
        docs = preflight(ends, a.from_prefix, a.to_prefix, seen)
    if a.checkpoint:
        if a.overwrite or a.complete or a.details:
            raise OptionError("an import with a checkpoint is loaded in steps, so it takes no --overwrite, --complete or --details")
        if a.input == "-":
            raise OptionError("standard input cannot be read again, so it takes no --checkpoint")
        counts = load_in_steps(db, a.collection, docs, a.checkpoint, a.on_duplicate, list(PLACE), max_docs=a.batch_docs)
    else:
        counts = db.load(a.collection, docs, a.on_duplicate, order=list(PLACE), overwrite=a.overwrite, complete=a.complete, details=a.details)
    if a.details:
        for row in spark.read.parquet(counts["refused"]).orderBy(*PLACE).toLocalIterator():
            event("refused", key=row["_key"], reason=row["reason"], file=row["file"], line=row["line"])
    skipped = seen.get["skipped_no_edge"] if seen else 0
    if skipped:
        event("warning", message=f"{skipped} rows name no edge and were left out")
    return counts | ({"skipped_no_edge": skipped} if seen else {})


def export_documents(spark: SparkSession, db: Database, a: argparse.Namespace) -> dict:
    if a.query:
        rows = db.query(a.query, dict(x.split("=", 1) for x in a.bind))
        docs = rows if rows.columns == ["doc"] else rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("doc"))
    else:
        docs = db.read(a.collection).select("doc")
    ordered = docs.select(F.monotonically_increasing_id().alias("ordinal"), "doc")
    fields = a.fields.split(",") if a.fields else None
    if a.single:
        return {"parts": 1, "bytes": export.write_single(ordered, f"{spark_path(a.output)}/{a.name}", a.format, fields=fields, codec=a.compression or infer_codec(a.name))}
    manifest = export.write_parts(ordered, spark_path(a.output), a.name, db.name, kind=a.format, fields=fields, codec=a.compression or infer_codec(a.name), threshold=a.part_bytes)
    return {"parts": len(manifest["artifacts"]), "bytes": sum(x["byte_size"] for x in manifest["artifacts"])}


def import_rdf(spark: SparkSession, db: Database, a: argparse.Namespace) -> dict:
    kind, path = a.format or infer_rdf_format(a.input), spark_path(a.input)
    triples = read_turtle(spark, path) if kind == "turtle" else read_statements(spark, path, kind == "nquads")
    triples = _stored(spark, triples, "triples")  # parsed once, read by every fold
    scope = a.input if a.scope is None else a.scope
    fold = rdf_graph.Fold(a.topology, a.vertices, a.edges, a.literals, a.named_graphs, scope)
    out = dict(zip(("triples_read", "vertices_built", "edges_built"), rdf_graph.summary(triples, fold).first()))
    for side, rows, kind in (("vertices", rdf_graph.vertices(triples, fold), "document"), ("edges", rdf_graph.edges(triples, fold), "edge")):
        keep = [c for c in rows.columns if c != "collection"]
        ready = rows.select("collection", *[c for c in ("_key", "_from", "_to") if c in rows.columns], F.to_json(F.struct(*keep)).alias("doc"))
        counts = db.load_many(ready, kind, "ignore")
        out[f"{side}_created"], out[f"{side}_ignored"] = counts["created"], counts["ignored"]
    return out


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docgraph", description=__doc__.splitlines()[0])
    top.add_argument("--catalog", required=True, help="folder of the catalog")
    top.add_argument("--database", default="_system")
    top.add_argument("--progress-seconds", type=float, default=5.0, help="between progress events")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("import")
    c.add_argument("input", help="a path, or - for standard input")
    c.add_argument("--collection", required=True)
    c.add_argument("--format", choices=("jsonl", "json", "csv", "tsv"))
    c.add_argument("--on-duplicate", default="error", choices=("error", "ignore", "replace", "update"))
    for flag in ("--datatype", "--translate", "--merge-attributes", "--remove-attribute"):
        c.add_argument(flag, action="append", default=[])
    for flag in ("--edges", "--overwrite", "--complete"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--details", action="store_true", help="list every refused row")
    c.add_argument("--checkpoint", help="a name; an import of it that was stopped goes on where it was")
    c.add_argument("--batch-docs", type=int, default=100_000, help="documents to a batch of a checkpoint")
    c.add_argument("--from-prefix")
    c.add_argument("--to-prefix")
    c = commands.add_parser("export")
    c.add_argument("output")
    c.add_argument("--name", default="export")
    what = c.add_mutually_exclusive_group(required=True)
    what.add_argument("--collection")
    what.add_argument("--query")
    c.add_argument("--bind", action="append", default=[])
    c.add_argument("--format", default="jsonl", choices=("jsonl", "json", "csv"))
    c.add_argument("--fields")
    c.add_argument("--compression", choices=("gzip", "zstd"))
    c.add_argument("--part-bytes", type=int, default=64 << 20)
    c.add_argument("--single", action="store_true", help="one object, OUTPUT/NAME, and no parts or manifest")
    c = commands.add_parser("dump")
    c.add_argument("output")
    c.add_argument("--include")
    c.add_argument("--exclude")
    c.add_argument("--include-system", action="store_true")
    c.add_argument("--all-databases", action="store_true")
    c.add_argument("--lease-seconds", type=float, default=600.0, help="after which the snapshot of a dump that died is given up")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--compression", choices=("gzip", "zstd"))
    c = commands.add_parser("restore")
    c.add_argument("input")
    c.add_argument("--checkpoint")
    c = commands.add_parser("rdf")
    c.add_argument("input")
    c.add_argument("--format", choices=("ntriples", "nquads", "turtle"))
    c.add_argument("--topology", default="pgt", choices=rdf_graph.TOPOLOGIES)
    c.add_argument("--literals", default="no-literals", choices=rdf_graph.LITERALS)
    c.add_argument("--named-graphs", default="ignore", choices=rdf_graph.GRAPHS)
    c.add_argument("--vertices", default="nodes")
    c.add_argument("--edges", default="links")
    c.add_argument("--scope", help="scope of blank nodes; by default the input's path, empty for none")
    c = commands.add_parser("graph")
    c.add_argument("action", choices=("create", "drop"))
    c.add_argument("name")
    c.add_argument("--edge", action="append", default=[])
    c.add_argument("--orphan", action="append", default=[])
    c.add_argument("--drop-collections", action="store_true")
    return top


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    db = Database(spark, spark_path(a.catalog), a.database)
    if a.command == "import":
        return import_documents(spark, db, a)
    if a.command == "export":
        return export_documents(spark, db, a)
    if a.command == "rdf":
        return import_rdf(spark, db, a)
    if a.command == "dump":
        names = listed(spark, spark_path(a.catalog)) if a.all_databases else [a.database]
        databases = [Database(spark, spark_path(a.catalog), n) for n in names]
        for name in [v for db in databases for v in dumps.views_left_out(db, a.include, a.exclude, a.include_system)]:
            event("warning", message=f"view '{name}' rests on collections that are not dumped, and is left out")
        manifest = dumps.dump(databases, spark_path(a.output), a.overwrite, a.all_databases, include=a.include, exclude=a.exclude, include_system=a.include_system, codec=a.compression, lease_seconds=a.lease_seconds)
        return {"artifacts": len(manifest["artifacts"])}
    if a.command == "restore":
        return {"restored": dumps.restore(spark, spark_path(a.catalog), spark_path(a.input), a.database, a.checkpoint)}
    if a.action == "create":
        return db.create_graph(a.name, a.edge, a.orphan)
    db.drop_graph(a.name, a.drop_collections)
    return {}


def _bad_place(spark: SparkSession, a: argparse.Namespace, error: Exception) -> dict | None:
    """Where a JSON-lines import met a line that is no JSON."""
    if a.command != "import" or "not a JSON value" not in str(error):
        return None
    return first_bad_line(spark, spark_path(a.input)) if a.input != "-" else None


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.getLogger("SQLQueryContextLogger").setLevel(logging.CRITICAL + 1)  # which would repeat a failing query on standard error
    spark = SparkSession.builder.appName("docgraph").getOrCreate()
    event("started", command=a.command)
    try:
        with progress(spark, a.progress_seconds):
            result = run(spark, a)
    except Exception as error:
        place = _bad_place(spark, a, error)
        if place:
            message = f"{place['file']}, line {place['line']}, column {place['column']}: {place['message']}"
            event("failed", error=message)
            print(json.dumps({"ok": False, "error": message}))
            return 2
        message = str(error).splitlines()[0]
        if getattr(a, "query", None):  # Spark's own errors repeat parts of a query
            message = redacted(message, [a.query, *(x.split("=", 1)[-1] for x in a.bind)])
        message = redacted(message) if "://" in message and "@" in message else message
        event("failed", error=message)
        print(json.dumps({"ok": False, "error": message}))
        return 2
    event("finished", command=a.command)
    print(json.dumps({"ok": not result.get("errors"), **result}))
    return int(bool(result.get("errors")))


if __name__ == "__main__":
    sys.exit(main())
