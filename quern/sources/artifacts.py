"""Files: token streams of uint16, JSON and JSONL, digest indexes, locks and configurations."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import json
import os
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_type_hints

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.integrity import compare_manifests, manifest, same_rows
from quern.operators.screen import check_index

VOCABULARY = 8192
CHUNK = 1 << 20


def check_stream(stream: DataFrame, stored_total: int, vocabulary: int = VOCABULARY) -> None:
    """(off, n, ids): exactly ``stored_total`` ids without gap, all in the vocabulary; else an error."""
    if stored_total <= 0:
        raise ValueError("a stream has at least one id")
    r = stream.agg(F.sum("n").alias("n"), F.max(F.col("off") + F.col("n")).alias("end"), F.min(F.array_min("ids")).alias("least"), F.max(F.array_max("ids")).alias("most")).first()
    if (r.n or 0) != stored_total or r.end != stored_total:
        raise RuntimeError(f"the stream has {r.n or 0} ids, not {stored_total}")
    if r.least < 0 or r.most >= vocabulary:
        raise RuntimeError(f"ids from {r.least} to {r.most} are not all in the vocabulary")


def files_of(spark: SparkSession, folder: str) -> tuple[str, str]:
    """(address, path) of a folder on the file system that Spark would use for it; tasks reach it by the address."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = path.makeQualified(files.getUri(), files.getWorkingDirectory()).toUri()
    return (f"file://{whole.getPath()}" if whole.getScheme() == "file" else whole.toString()), whole.getPath()


def write_stream(stream: DataFrame, folder: str, stored_total: int, vocabulary: int = VOCABULARY, chunk: int = CHUNK, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Write the ids as little-endian uint16 in files of ``chunk`` ids, named by their place; (part, path, ids, stored_so_far).

    The stream is written once, when this is called. Files are written by the tasks that hold them, each under another name
    until it is whole, so that a task may run again; the folder must be one that all of them reach, and must not be there yet.
    ``progress`` is called with part and stored ids for each file in order when all are there. A failure leaves no folder.
    """
    if chunk <= 0:
        raise ValueError("a chunk has at least one id")
    check_stream(stream, stored_total, vocabulary)
    spark = stream.sparkSession
    address, plain = files_of(spark, folder)
    store, base = FileSystem.from_uri(address)
    if store.get_file_info(base).type != FileType.NotFound:
        raise FileExistsError(folder)
    store.create_dir(base, recursive=True)
    each = stream.where("n > 0").select("off", "n", "ids", F.explode(F.sequence(F.expr(f"off div {chunk}"), F.expr(f"(off + n - 1) div {chunk}"))).alias("part"))
    start, stop = F.greatest(F.col("off"), F.col("part") * chunk), F.least(F.col("off") + F.col("n"), (F.col("part") + 1) * chunk)
    cut = each.select("part", start.alias("at"), F.slice("ids", (start - F.col("off") + 1).cast("int"), (stop - start).cast("int")).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(address)
        held: list[np.ndarray] = []
        part, done = None, []

        def close() -> None:
            data = np.concatenate(held).astype("<u2").tobytes()
            name, draft = f"{base}/part-{part:08d}.u16", f"{base}/.part-{part:08d}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            store.move(draft, name)
            done.append((part, name, len(data) // 2))

        for b in batches:
            for p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if p != part and held:
                    close()
                    held = []
                part = p
                held.append(np.asarray(ids, np.int64))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["part", "path", "ids"])

    parts = -(-stored_total // chunk)
    try:
        files = cut.repartition(min(parts, 10_000), "part").sortWithinPartitions("part", "at").mapInArrow(run, "part bigint, path string, ids bigint").toArrow().sort_by("part")  # a row for each file
        if sum(files["ids"].to_pylist()) != stored_total:
            raise RuntimeError("not every id was written")
        for x in store.get_file_info(FileSelector(base)):
            if x.base_name.startswith(".part-"):  # of a task that was lost
                store.delete_file(x.path)
    except BaseException:
        store.delete_dir(base)
        raise
    so_far = np.minimum(stored_total, np.cumsum(files["ids"].to_numpy()))
    for part, n in zip(files["part"].to_pylist(), so_far.tolist()):
        if progress:
            progress(part, n)
    return spark.createDataFrame(files.append_column("stored_so_far", pa.array(so_far, pa.int64())))


def read_stream(spark: SparkSession, folder: str, chunk: int = CHUNK, visible: int | None = None) -> DataFrame:
    """(off, n, ids) of the files of a stream; ``visible`` shows only so many ids from its start."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.u16").load(folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                off = part * chunk
                ids = np.frombuffer(content, "<u2").astype(np.int32)
                if visible is not None:
                    ids = ids[: max(0, visible - off)]
                if len(ids):
                    yield pa.RecordBatch.from_pylist([{"off": off, "n": len(ids), "ids": ids}], schema=pa.schema([("off", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return files.select(F.regexp_extract("path", r"part-(\d+)\.u16$", 1).cast("bigint").alias("part"), "content").mapInArrow(run, "off bigint, n bigint, ids array<int>")


def stream_sha256(folder: str) -> str:
    """Digest of the stream's bytes, file by file in order."""
    store, base = FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    digest = hashlib.sha256()
    for x in sorted(x.path for x in store.get_file_info(FileSelector(base)) if x.base_name.startswith("part-") and x.base_name.endswith(".u16")):
        with store.open_input_stream(x) as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def copy_index(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A copy of a digest index, which must not be there yet, read again and compared; a difference is an error."""
    index = read_index(spark, path)
    index.write.parquet(target)
    copy = read_index(spark, target)
    if not same_rows(index, copy):
        raise RuntimeError(f"{target} is not what {path} is")
    return copy


@dataclass(frozen=True)
class Expected:
    """What a bundle must be. Digests that are None are read from the bundle's own manifest; ``prefixes`` are (name, ids, digest), each longer than the one before."""

    ids: tuple[str, ...]
    dataset: dict
    vocabulary: int
    special_tokens: tuple[str, ...]
    context: int
    prediction_tokens: int
    validation_tokens: int
    tokenizer_sha256: str | None = None
    stream_sha256: str | None = None
    screened: tuple[str, ...] = ()
    validations: dict = field(default_factory=lambda: {"general": None})
    prefixes: tuple[tuple[str, int, str], ...] = ()
    mixture: dict | None = None


@dataclass(frozen=True)
class Bundle:
    stream: DataFrame
    validations: dict
    manifest: dict
    manifest_sha256: str


def windows_digests(windowed: DataFrame) -> tuple[int, str, str]:
    """(target ids, digest of inputs, digest of targets) of a held-out set, over its windows in order as little-endian int64."""
    inputs, targets, n = hashlib.sha256(), hashlib.sha256(), 0
    for r in windowed.orderBy("window_id").toLocalIterator():  # a held-out set, of fixed size
        ids = np.asarray(r.ids, "<i8")
        inputs.update(ids[:-1].tobytes())
        targets.update(ids[1:].tobytes())
        n += len(ids) - 1
    return n, inputs.hexdigest(), targets.hexdigest()


def bundle_problems(spark: SparkSession, folder: str, want: Expected) -> list[str]:
    """Everything in which a bundle isn't what is expected; empty if nothing."""
    listed = read_json_object(Path(folder, "manifest.json"))
    found: list[str] = []

    def check(ok: bool, message: str) -> None:
        if not ok:
            found.append(message)

    def part(name: str, of: dict = listed) -> dict:
        return x if isinstance(x := of.get(name), dict) else {}

    check(listed.get("id") in want.ids, "id")
    check(listed.get("mode") == "full_stream", "mode")
    check(all(part("dataset").get(k) == v for k, v in want.dataset.items()), "dataset")
    files = compare_manifests(spark.createDataFrame([(x["path"], x["bytes"], x["sha256"]) for x in listed.get("files", [])], "path string, bytes bigint, sha256 string"), manifest(spark, folder, exclude=("manifest.json", "SHA256SUMS")))
    found += [f"{p.path} {p.problem}" for p in files.limit(20).collect()]

    tokenizer, stream = part("tokenizer"), part("stream")
    check(tokenizer.get("vocab_size") == want.vocabulary and tokenizer.get("special_tokens") == list(want.special_tokens), "vocabulary")
    path = Path(folder, str(tokenizer.get("file", "tokenizer.json")))
    digest = hashlib.sha256(path.read_bytes()).hexdigest() if path.is_file() else None
    check(digest is not None and digest == tokenizer.get("sha256") == (want.tokenizer_sha256 or digest), "tokenizer digest")

    stored = want.prediction_tokens + 1
    check(stream.get("storage") == "uint16" and stream.get("context") == want.context and stream.get("non_cycled") is True, "stream form")
    check(want.prediction_tokens % want.context == 0 and stream.get("windows") == want.prediction_tokens // want.context, "stream windows")
    check(stream.get("prediction_tokens") == want.prediction_tokens and stream.get("stored_ids") == stored and stream.get("bytes") == 2 * stored, "stream size")
    sizes = [p.stat().st_size for p in Path(folder, "stream").glob("part-*.u16")]
    check(sum(sizes) == 2 * stored, "stream bytes")
    digest = stream_sha256(str(Path(folder, "stream"))) if sizes else None
    check(digest is not None and digest == stream.get("sha256") == (want.stream_sha256 or digest), "stream digest")
    if want.prefixes and sizes:
        found += [f"prefix {x}" for x in broken_prefixes(*FileSystem.from_uri(os.path.abspath(Path(folder, "stream"))), want.prefixes)]
        for name, n, sha in want.prefixes:
            said = part(name, part("prefixes"))
            check(said.get("ids") == n and said.get("sha256") == sha and said.get("match") is True, f"prefix {name} in the manifest")

    for name, digests in want.validations.items():
        said = part(name, part("validations"))
        at = Path(folder, str(said.get("file", f"validation-{name}")))
        check(name not in want.screened or said.get("contamination_screened") is True, f"{name} validation not screened")
        if not at.exists():
            found.append(f"{name} validation missing")
            continue
        rows = spark.read.parquet(str(at))
        check(rows.where(F.coalesce(F.size("ids") != want.context + 1, F.lit(True))).isEmpty(), f"{name} validation shape")
        n, *own = windows_digests(rows)
        check(n == said.get("prediction_tokens") == want.validation_tokens, f"{name} validation size")
        check(own == [said.get("inputs_sha256"), said.get("targets_sha256")] and own == list(digests or own), f"{name} validation digests")

    if want.mixture is not None:
        mixture = part("mixture")
        check(mixture.get("deduplication") == "canonical_content_sha256" and mixture.get("sources") == want.mixture.get("sources") and (mixture.get("unique_documents") or 0) > 0, "mixture")
        check(mixture.get("target_prediction_tokens") == want.mixture.get("target_prediction_tokens"), "mixture targets")
        check(sum(part("actual_prediction_tokens", mixture).values()) == want.prediction_tokens, "mixture accounting")
    return found


def broken_prefixes(store: FileSystem, folder: str, links: Iterable[tuple[str, int, str]]) -> list[str]:
    """Names of the (name, ids, sha256) that aren't prefixes of a stream, whose files are read once; each must be longer than the one before."""

    def blocks() -> Iterator[bytes]:
        for x in sorted(x.path for x in store.get_file_info(FileSelector(folder)) if x.base_name.endswith(".u16")):
            with store.open_input_stream(x) as f:
                while block := f.read(1 << 20):
                    yield block

    digest, at, broken, own, rest = hashlib.sha256(), 0, [], blocks(), b""
    for name, n, sha in links:
        while at < 2 * n and (rest or (rest := next(own, b""))):
            take = rest[: 2 * n - at]
            digest.update(take)
            at, rest = at + len(take), rest[len(take) :]
        if at < 2 * n or digest.hexdigest() != sha:
            broken.append(name)
    return broken


def open_bundle(spark: SparkSession, folder: str, want: Expected, chunk: int = CHUNK, visible: int | None = None) -> Bundle:
    """A bundle that is all that is expected, else an error that names every difference."""
    if problems := bundle_problems(spark, folder, want):
        raise RuntimeError(f"{folder}: " + ", ".join(problems))
    listed = read_json_object(Path(folder, "manifest.json"))
    sets = {name: spark.read.parquet(str(Path(folder, str(listed["validations"][name].get("file", f"validation-{name}"))))) for name in want.validations}
    return Bundle(read_stream(spark, f"{folder}/stream", chunk, visible), sets, listed, hashlib.sha256(Path(folder, "manifest.json").read_bytes()).hexdigest())


def load_bundle(spark: SparkSession, folder: str, chunk: int = CHUNK, visible: int | None = None) -> DataFrame:
    """The stream of an artifact folder whose files are those of its manifest.json; missing, added or altered files are errors."""
    listed = read_json_object(Path(folder, "manifest.json"))["files"]
    expected = spark.createDataFrame([(x["path"], x["bytes"], x["sha256"]) for x in listed], "path string, bytes bigint, sha256 string")
    problems = compare_manifests(expected, manifest(spark, folder, exclude=("manifest.json", "SHA256SUMS"))).limit(20).collect()
    if problems:
        raise RuntimeError(f"{folder}: " + ", ".join(f"{p.path} {p.problem}" for p in problems))
    return read_stream(spark, f"{folder}/stream", chunk, visible)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A digest index; a value that is no 32-byte digest is an error."""
    index = spark.read.parquet(path).select("value")
    if not check_index(index).isEmpty():
        raise ValueError(f"{path} has values that are no digests")
    return index


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, event: str | None = None) -> DataFrame:
    """Line-delimited JSON records, of one ``event`` if given; a broken line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if event is None else rows.where(F.col("event") == event)


def read_zipped_jsonl(spark: SparkSession, path: str, members: str, schema: StructType | str) -> DataFrame:
    """JSON records, a line each, of the members of zip archives whose names match a pattern (``*`` and ``?``); a broken line is an error.

    Each archive is opened where it is read. Archives from elsewhere are fetched to the shared folder first, once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(x for x in z.namelist() if fnmatch.fnmatchcase(x, members)):
                        with z.open(name) as f:
                            while lines := f.readlines(1 << 22):
                                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in lines if x.strip()], pa.string())], names=["line"])

    files = spark.read.format("binaryFile").load(path).select("content")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    return files.mapInArrow(run, "line string").select(F.from_json("line", kind, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def read_json_object(path: str | Path) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


@dataclass(frozen=True)
class BenchmarkSource:
    task: str
    revision: str
    splits: tuple[str, ...]


def read_benchmark_lock(path: str | Path, tasks: tuple[str, ...]) -> list[BenchmarkSource]:
    """The locked sources in the order of ``tasks``; other tasks, missing ones, or a revision that is no full commit are errors."""
    value = read_json_object(path)
    if set(value) != set(tasks):
        raise ValueError("the lock names other tasks than expected")
    out = []
    for t in tasks:
        revision = value[t]["revision"]
        if len(revision) != 40 or set(revision) - set("0123456789abcdef"):
            raise ValueError(f"{t}: the revision is no full commit")
        out.append(BenchmarkSource(t, revision, tuple(value[t]["splits"])))
    return out


def construct(kind: type, values: dict):
    """A frozen configuration from nested values; a field missing or unknown is an error."""
    own = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(own):
        raise ValueError(f"unknown fields of {kind.__name__}: {sorted(unknown)}")
    if missing := {n for n, f in own.items() if f.default is MISSING and f.default_factory is MISSING} - set(values):
        raise ValueError(f"missing fields of {kind.__name__}: {sorted(missing)}")
    hints = get_type_hints(kind)
    return kind(**{n: construct(hints[n], v) if is_dataclass(hints[n]) and isinstance(v, dict) else v for n, v in values.items()})


@dataclass(frozen=True)
class SourceDescriptor:
    """Where a corpus source comes from; a moving revision isn't allowed."""

    name: str
    path: str
    revision: str
    text_field: str = "text"

    def __post_init__(self) -> None:
        if not self.revision or self.revision.lower() in {"head", "main", "master", "latest"}:
            raise ValueError("an immutable revision must be given")
