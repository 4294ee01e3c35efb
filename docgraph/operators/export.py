"""Exports: JSON lines, JSON arrays and guarded CSV, whole or in standalone parts with a manifest."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..options import OptionError
from ..scratch import discard, stored
from .batching import PART_BYTES, assign_parts

FORMATS = {"jsonl": "jsonl", "json": "json", "csv": "csv"}
SUFFIX = {None: "", "gzip": ".gz", "zstd": ".zst"}
MANIFEST_VERSION = 1
FRAME_DOCS, FRAME_BYTES = 4096, 4 << 20
READ_BYTES = 1 << 20  # of a part's text that are split into documents at once


def csv_lines(df: DataFrame, fields: list[str], doc_col: str = "doc", order: str | None = None) -> DataFrame:
    """(doc) one CSV record of each document, guarded and quoted; ``order`` is carried along."""
    if not fields:
        raise OptionError("csv export needs a list of fields")
    carried = df.select(*([F.col(order)] if order else []), F.col(doc_col))
    record = F.concat_ws(",", *[_quoted(cells.csv_cell(c)) for c in json_cells(fields, doc_col)])
    return carried.select(*([order] if order else []), record.alias("doc"))


def json_cells(fields: list[str], doc_col: str = "doc") -> Iterator[Column]:
    """A cell per top-level field of a JSON document; an absent field is null."""
    value = F.try_parse_json(doc_col)
    for name in fields:
        member = F.try_variant_get(value, f"$['{name}']", "variant")
        kind = F.schema_of_variant(member)
        number = F.when(kind == "BIGINT", "int").when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float")
        tag = F.when(F.is_variant_null(member), "null").when(kind == "BOOLEAN", "bool").otherwise(F.coalesce(number, F.lit("str")))
        text = F.when(kind == "STRING", F.try_variant_get(value, f"$['{name}']", "string")).otherwise(F.to_json(member))
        yield F.when(member.isNotNull(), F.struct(tag.alias("t"), text.alias("s")))


def _quoted(text):
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_jsonl(df: DataFrame, path: str, codec: str | None = None) -> None:
    """Distributed: a file for each task.  With zstd, which the text writer has not, each task writes frames of a bounded size."""
    if codec != "zstd":
        df.select("doc").write.text(path, compression=codec or "none")
        return

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        out = None
        for batch in batches:
            if out is None:
                out = _output(f"{path}/part-{TaskContext.get().partitionId():05d}.{TaskContext.get().taskAttemptId()}.jsonl.zst")
            for at in range(0, len(batch), FRAME_DOCS):
                out.write(zstandard.ZstdCompressor().compress("".join(f"{d}\n" for d in batch["doc"][at : at + FRAME_DOCS]).encode()))
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [out.name]})

    put(df.sparkSession, f"{path}/_WRITING", b"")
    # Only what the tasks that count have written stays: an attempt that was lost leaves a file of another number.
    whole = {r.path for r in df.select("doc").mapInPandas(store, "path string").collect()}
    for name in listed(df.sparkSession, path):
        if name.endswith(".zst") and name not in {w.rpartition("/")[2] for w in whole}:
            delete(df.sparkSession, f"{path}/{name}")
    delete(df.sparkSession, f"{path}/_WRITING")
    put(df.sparkSession, f"{path}/_SUCCESS", b"")


class _output:
    """A file that a task writes through the file system its path names."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(place.rpartition("/")[0])
        self.name, self._stream = place, system.open_output_stream(place, compression=None)
        self.write, self.close = self._stream.write, self._stream.close


def _frame(kind: str, fields: list[str] | None) -> tuple[str, str, str]:
    """What opens a part, separates records, and closes it."""
    if kind == "json":
        return "[", ",", "]"
    head = ",".join(fields) + "\n" if kind == "csv" else ""
    return head, "\n", "\n"


def part_bytes_of(docs: list[str], kind: str, fields: list[str] | None, codec: str | None) -> bytes:
    opening, between, closing = _frame(kind, fields)
    body = (opening + between.join(docs) + (closing if docs or kind == "json" else "")).encode()
    if codec == "gzip":
        return gzip.compress(body, mtime=0)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(body)
    return body


def write_single(df: DataFrame, path: str, kind: str = "jsonl", order: str = "ordinal", fields: list[str] | None = None, codec: str | None = None) -> int:
    """One object of all documents in ``order``, as JSON lines, one JSON array or CSV with a header; returns its bytes.

    Sorting and encoding are spread; one task writes, as a stream.  The object appears under its name when it is whole.
    """
    if codec == "zstd":
        return _single_of_frames(df, path, kind, order, fields)
    rows = stored(csv_lines(df, fields or [], order=order) if kind == "csv" else df.select(order, "doc"), "export")
    spark, first = df.sparkSession, rows.agg(F.min(order)).first()[0]
    if first is None:
        discard(rows)
        put(spark, path, part_bytes_of([], kind, fields, codec))
        return head(spark, path)
    opening = _frame(kind, fields)[0]
    text = F.when(F.col(order) == F.lit(first), F.concat(F.lit(opening), "doc")).otherwise(F.concat(F.lit("," if kind == "json" else ""), "doc"))
    body = rows.orderBy(order).select(text.alias("value"))
    if kind == "json":
        body = body.unionByName(spark.createDataFrame([("]",)], "value string"))
    body = body.coalesce(1)
    staged = f"{path}.writing"
    body.write.mode("overwrite").text(staged, lineSep="\n", compression=codec or "none")
    system, target = _system(spark, path)
    (name,) = [n for n in listed(spark, staged) if n.startswith("part-")]
    system.delete(target, True)
    system.rename(_system(spark, f"{staged}/{name}")[1], target)
    system.delete(_system(spark, staged)[1], True)
    discard(rows)
    return head(spark, path)


def _single_of_frames(df: DataFrame, path: str, kind: str, order: str, fields: list[str] | None) -> int:
    """The single object as zstd frames, which tasks make of consecutive documents, one after another in one task's stream."""
    spark = df.sparkSession
    opening, between, closing = _frame(kind, fields)
    rows = csv_lines(df, fields or [], order=order) if kind == "csv" else df.select(order, "doc")
    parted = stored(assign_parts(rows, order, FRAME_BYTES).withColumnRenamed(order, "__order"), "frames")
    last = parted.agg(F.max("part")).first()[0]
    if last is None:
        put(spark, path, part_bytes_of([], kind, fields, "zstd"))
        return head(spark, path)

    def frame(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        number = int(key[0])
        text = (opening if number == 0 else between if kind == "json" else "") + between.join(group.sort_values("__order")["doc"])
        text += closing if kind != "json" or number == last else ""
        return pd.DataFrame([(number, zstandard.ZstdCompressor().compress(text.encode()))], columns=["part", "frame"])

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _output(f"{path}.writing")
        for batch in batches:
            for content in batch["frame"]:
                out.write(content)
        out.close()
        yield pd.DataFrame({"path": [out.name]})

    frames = stored(parted.groupBy("part").applyInPandas(frame, "part long, frame binary"), "frames")
    frames.orderBy("part").select("frame").coalesce(1).mapInPandas(store, "path string").collect()
    system, target = _system(spark, path)
    system.delete(target, True)
    system.rename(_system(spark, f"{path}.writing")[1], target)
    discard(parted, frames)
    return head(spark, path)


PARTS = "part int, path string, format string, compression string, byte_size long, sha256 string"


@dataclass
class Parts:
    """``rows`` (part, doc), in a task one part after another and each in its order, and how they are stored."""

    rows: DataFrame
    base: str
    kind: str
    fields: list[str] | None
    codec: str | None


def encode_parts(df: DataFrame, base: str, kind: str = "jsonl", order: str = "ordinal", fields: list[str] | None = None, codec: str | None = None, threshold: int = PART_BYTES) -> Parts:
    """The parts of ``df``'s documents, for ``store_parts``.  A part is bounded by its threshold and one record."""
    if kind not in FORMATS:
        raise OptionError(f"unknown export format '{kind}'")
    rows = csv_lines(df, fields or [], order=order) if kind == "csv" else df.select(order, "doc")
    opening = len(_frame(kind, fields)[0].encode())
    parted = assign_parts(rows, order, threshold, opening)
    return Parts(parted.repartition("part").sortWithinPartitions("part", order).select("part", "doc"), base, kind, fields, codec)


class _PartFile:
    """A part that a task writes piece by piece, and what describes it in the end."""

    def __init__(self, path: str, codec: str | None):
        self._out, self._sum, self._size, self._packer = _output(path), hashlib.sha256(), 0, None
        if codec == "gzip":
            self._packer = zlib.compressobj(9, zlib.DEFLATED, 31)
        elif codec == "zstd":
            import zstandard

            self._packer = zstandard.ZstdCompressor().compressobj()

    def _store(self, piece: bytes) -> None:
        self._sum.update(piece)
        self._size += len(piece)
        self._out.write(piece)

    def write(self, text: str) -> None:
        self._store(self._packer.compress(text.encode()) if self._packer else text.encode())

    def close(self) -> tuple[int, str]:
        """(bytes, checksum) of what is stored."""
        if self._packer:
            self._store(self._packer.flush())
        self._out.close()
        return self._size, self._sum.hexdigest()


def write_parts(df: DataFrame, folder: str, base: str, database: str | None = None, created_at: str | None = None, **options) -> dict:
    """Writes every part, then the manifest; an empty export is one valid empty part.  Returns the manifest."""
    spark = df.sparkSession
    parts = encode_parts(df, base, **options)

    rows = store_parts(parts, folder)
    if not rows:
        kind, codec = options.get("kind", "jsonl"), options.get("codec")
        content = part_bytes_of([], kind, options.get("fields"), codec)
        one = {"part": 0, "path": f"{base}.part-00000.{FORMATS[kind]}{SUFFIX[codec]}", "format": kind, "compression": codec or "none", "byte_size": len(content), "sha256": hashlib.sha256(content).hexdigest()}
        put(spark, f"{folder}/{one['path']}", content)
        rows = [one]
    manifest = {
        "manifest_version": MANIFEST_VERSION, "database": database, "created_at": created_at or datetime.now(timezone.utc).isoformat(),
        "artifacts": [{"kind": "data", **{k: r[k] for k in ("path", "format", "compression", "byte_size", "part")}, "encryption": "none", "checksum": {"algorithm": "sha256", "value": r["sha256"]}} for r in rows],
    }
    put(spark, f"{folder}/{base}.manifest.json", json.dumps(manifest, indent=2).encode())
    return manifest


def store_parts(parts: Parts, folder: str) -> list[dict]:
    """Each task writes its own parts, as streams; what describes them comes back, in order."""
    base, kind, codec = parts.base, parts.kind, parts.codec
    opening, between, closing = _frame(kind, parts.fields)
    ending = f".{FORMATS[kind]}{SUFFIX[codec]}"
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, path, out = None, "", None

        def closed() -> pa.RecordBatch:
            out.write(closing)
            row = (number, path, kind, codec or "none", *out.close())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            numbers, docs = batch.column(0).to_numpy(), batch.column(1)
            cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist() if len(numbers) else []
            for first, stop in zip([0, *cuts], [*cuts, len(numbers)] if len(numbers) else []):
                if numbers[first] != number:
                    if out:
                        yield closed()
                    number = int(numbers[first])
                    path = f"{base}.part-{number:05d}{ending}"
                    out = _PartFile(f"{folder}/{path}", codec)
                    out.write(opening)
                else:
                    out.write(between)
                out.write(between.join(docs.slice(first, stop - first).to_pylist()))
        if out:
            yield closed()

    return [r.asDict() for r in parts.rows.mapInArrow(store, PARTS).orderBy("part").collect()]


def put(spark: SparkSession, path: str, content: bytes | Iterator[bytes], overwrite: bool = True) -> bool:
    """Store one object through Hadoop's file systems, whole or in pieces; False if it exists and may not be overwritten."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if not overwrite and system.exists(target):
        return False
    try:
        out = system.create(target, overwrite)
    except Exception as error:
        if not overwrite and "FileAlreadyExists" in str(error):
            return False
        raise
    try:
        for piece in [content] if isinstance(content, bytes) else content:
            out.write(bytearray(piece))
    finally:
        out.close()
    return True


def publish(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create one object whole or not at all; False if there is one already, whoever wrote it.

    The bytes are written aside and get their name in one step that fails where the name is taken: a hard link on a local disk, a
    rename that does not overwrite on HDFS.  Object stores are asked for a conditional write, and one that has none is refused.
    """
    jvm = spark._jvm
    system, target = _system(spark, path)
    target = system.makeQualified(target)
    scheme = target.toUri().getScheme()
    if scheme not in ("file", "hdfs", "viewfs"):
        builder = system.createFile(target).overwrite(False).recursive().must("fs.option.create.conditional.overwrite", True)
        try:
            out = builder.build()
            out.write(bytearray(content))
            out.close()
        except Exception as error:
            if any(x in str(error) for x in ("FileAlreadyExists", "PreconditionFailed", "412")):
                return False
            raise
        return True
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.aside")
    put(spark, aside.toString(), content)
    try:
        if scheme == "file":
            name = jvm.java.nio.file.Paths.get
            jvm.java.nio.file.Files.createLink(name(target.toUri()), name(aside.toUri()))
        else:
            never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, never)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    finally:
        system.delete(aside, False)
    return True


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def get(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> bytes:
    """An object's bytes, or those of [start, end) alone, which is all that is read."""
    system, target = _system(spark, path)
    size = system.getFileStatus(target).getLen()
    start, end = min(start, size), size if end is None else min(end, size)
    stream = system.open(target)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(max(0, end - start)))
    finally:
        stream.close()


def head(spark: SparkSession, path: str) -> int | None:
    """An object's size in bytes, or None if there is none."""
    system, target = _system(spark, path)
    return system.getFileStatus(target).getLen() if system.exists(target) else None


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no folder."""
    system, target = _system(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []


def rename(spark: SparkSession, path: str, target: str) -> bool:
    """Move a folder to where there is none; False if there is nothing to move."""
    system, old = _system(spark, path)
    if not system.exists(old):
        return False
    new = _system(spark, target)[1]
    system.mkdirs(new.getParent())
    return system.rename(old, new)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def delete(spark: SparkSession, path: str) -> None:
    """Idempotent."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def relative(path: str) -> str:
    """``path`` if it stays below its folder, else an error."""
    if path.startswith("/") or any(x in ("..", ".", "") for x in path.split("/")):
        raise OptionError(f"path '{path}' leaves its folder")
    return path


def read_parts(spark: SparkSession, folder: str, manifest: dict, verify: bool = True) -> DataFrame:
    """(part, ordinal, doc) of a jsonl part export, in manifest order; checksums are verified first."""
    data = [a for a in manifest["artifacts"] if a["kind"] == "data"]
    paths = [f"{folder}/{relative(a['path'])}" for a in data]
    files = spark.read.format("binaryFile").load(paths).select("content", F.element_at(F.split("path", "/"), -1).alias("name"))
    table = spark.createDataFrame([(a["path"].split("/")[-1], a["part"], a["compression"], (a.get("checksum") or {}).get("value")) for a in data], "name string, part int, codec string, sha string")
    joined = files.join(F.broadcast(table), "name").select("part", "name", "codec", "sha", "content")
    names, kinds = ["part", "ordinal", "doc"], [pa.int32(), pa.int64(), pa.string()]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (part, name, codec, sha) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                content, at = batch.column(4)[k].as_buffer(), 0
                if verify and sha and hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"checksum of {name} does not match the manifest")
                for docs in _documents(content, codec):
                    columns = [np.full(len(docs), part), np.arange(at, at + len(docs)), docs]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
                    at += len(docs)

    return joined.mapInArrow(lines, T.StructType.fromDDL("part int, ordinal long, doc string"))


def _documents(content: pa.Buffer, codec: str) -> Iterator[list[str]]:
    """The lines of a part that are not blank, some at a time."""
    rest = b""
    with _unpacked(content, codec) as stream:
        while piece := stream.read(READ_BYTES):
            *whole, rest = (rest + piece).split(b"\n")
            docs = [d for d in map(bytes.decode, whole) if d.strip()]
            if docs:
                yield docs
    if rest.decode().strip():
        yield [rest.decode()]


def _unpacked(content: pa.Buffer, codec: str):
    if codec == "gzip":
        return gzip.GzipFile(fileobj=pa.BufferReader(content))
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    return pa.BufferReader(content)


def decompressed(content: bytes, codec: str) -> bytes:
    if codec == "gzip":
        return gzip.decompress(content)
    if codec == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as frames:
            return frames.read()
    return content
