"""Checks that give their violations as rows, manifests, prefixes and replays."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row doesn't hold; a rule that is null doesn't hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def all_violations(tables: dict[str, tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """(table, key, rule) of every rule of every table that a row doesn't hold: all errors together, none stops the others."""
    out = None
    for name, (rows, key, rules) in tables.items():
        part = violations(rows, key, rules).select(F.lit(name).alias("table"), "key", "rule")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table to check")
    return out


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def share(c: Column) -> Column:
    return finite(c) & c.between(0.0, 1.0)


def manifest(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, bytes, sha256) of each file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/") + "/" if re.match(r"[a-z0-9]+:/", folder) and not folder.startswith("file:") else os.path.abspath(re.sub(r"^file:/*", "/", folder)) + "/"
    path = F.substring_index(F.col("path"), root, -1)
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).where(~F.col("path").isin(*exclude) if exclude else F.lit(True))


def compare_manifests(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files missing, added or altered; empty if the sets are the same."""
    both = expected.select("path", F.col("bytes").alias("b1"), F.col("sha256").alias("s1"), F.lit(True).alias("l")).join(found.select("path", F.col("bytes").alias("b2"), F.col("sha256").alias("s2"), F.lit(True).alias("r")), "path", "full")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").when((F.col("b1") != F.col("b2")) | (F.col("s1") != F.col("s2")), "altered")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def write_manifest(files: DataFrame, folder: str) -> None:
    """SHA256SUMS and manifest.json beside the files, sorted by path; neither is replaced if there."""
    rows = files.orderBy("path").collect()  # a listing of one artifact folder
    sums, listing = Path(folder, "SHA256SUMS"), Path(folder, "manifest.json")
    for p in (sums, listing):
        if p.exists():
            raise FileExistsError(p)
    write_json(listing, {"files": [{"path": r.path, "bytes": r.bytes, "sha256": r.sha256} for r in rows]})
    own = [("manifest.json", hashlib.sha256(listing.read_bytes()).hexdigest())]
    sums.write_text("".join(f"{d}  {p}\n" for p, d in sorted([(r.path, r.sha256) for r in rows] + own)))


def write_json(path: str | Path, value: object) -> None:
    """Atomically: a file in the same folder takes the name once it is complete."""
    path = Path(path)
    part = path.with_name(f".{path.name}.{os.getpid()}.part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")
    os.replace(part, path)


def append_durable(path: str | Path, record: dict) -> None:
    """One line of JSON with sorted keys, on disk when this returns."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True, allow_nan=False) + "\n")
        f.flush()
        os.fsync(f.fileno())


def sha256_prefix(path: str | Path, n: int) -> str:
    """Of the first ``n`` bytes; a shorter file is an error."""
    if n <= 0:
        raise ValueError("a prefix has at least one byte")
    digest, left = hashlib.sha256(), n
    with open(path, "rb") as f:
        while left:
            if not (block := f.read(min(left, 1 << 20))):
                raise ValueError(f"{path} is {left} bytes too short")
            digest.update(block)
            left -= len(block)
    return digest.hexdigest()


def prefix_matches(path: str | Path, n: int, expected: str) -> bool:
    """Whether the first ``n`` bytes have the digest; a shorter file has not."""
    try:
        return sha256_prefix(path, n) == expected
    except ValueError:
        return False


def prefix_chain(path: str | Path, links: list[tuple[str, int, str]]) -> list[str]:
    """Names of the (name, bytes, sha256) that aren't prefixes of the file, read once; lengths must grow."""
    if any(b[1] <= a[1] for a, b in zip(links, links[1:])) or any(n <= 0 for _, n, _ in links):
        raise ValueError("each prefix must be longer than the one before")
    digest, at, broken = hashlib.sha256(), 0, []
    with open(path, "rb") as f:
        for name, n, expected in links:
            while at < n and (block := f.read(min(n - at, 1 << 20))):
                digest.update(block)
                at += len(block)
            if at < n or digest.hexdigest() != expected:
                broken.append(name)
    return broken


def verify_prefix(path: str | Path, n: int, expected: str) -> None:
    if (found := sha256_prefix(path, n)) != expected:
        raise RuntimeError(f"the first {n} bytes of {path} have digest {found}, not {expected}")


def drift(stream: DataFrame, replay: DataFrame) -> DataFrame:
    """(off, problem) of each document at which two streams of (off, ids, source) differ, by place; empty if they are the same."""
    left = stream.select("off", F.col("ids").alias("i1"), F.col("source").alias("s1"), F.lit(True).alias("l"))
    right = replay.select("off", F.col("ids").alias("i2"), F.col("source").alias("s2"), F.lit(True).alias("r"))
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").when(F.col("i1") != F.col("i2"), "ids").when(~F.col("s1").eqNullSafe(F.col("s2")), "source")
    return left.join(right, "off", "full").select("off", problem.alias("problem")).where("problem is not null")


def prefix_gate(longer: DataFrame, shorter: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the shorter stream that the longer one doesn't have at the same place."""
    return shorter.select(*keys).exceptAll(longer.select(*keys))


def flatten_json(value: object, path: str = "") -> dict[str, str]:
    """Each leaf of a nested configuration by its path."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in flatten_json(x, f"{path}.{name}" if path else str(name)).items()}
    return {path: json.dumps(value, sort_keys=True)}


def config_difference(spark: SparkSession, one: dict, other: dict, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(path, one, other) of the leaves that differ outside the allowed paths."""
    schema = "path string, value string"
    a, b = (spark.createDataFrame(list(flatten_json(x).items()) or [], schema) for x in (one, other))
    both = a.withColumnRenamed("value", "one").join(b.withColumnRenamed("value", "other"), "path", "full")
    return both.where(~F.col("one").eqNullSafe(F.col("other"))).where(~F.col("path").isin(*allowed) if allowed else F.lit(True))


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_DEFINITION = re.compile(r" {0,3}\[(?:[^\]\\]|\\.)+\]:\s*(<[^<>]*>|\S+)")


def _unfenced(text: str) -> list[str]:
    """Lines outside fenced code; a fence is closed by one of the same sign that is as long."""
    out, fence = [], ""
    for line in text.splitlines():
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
        elif mark:
            fence = mark[1]
        else:
            out.append(line)
    return out


def _closing(text: str, at: int, pair: str) -> int:
    """Place of the bracket that closes the one at ``at``, or -1; escaped ones don't count."""
    depth, k = 0, at
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif c == pair[0]:
            depth += 1
        elif c == pair[1]:
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def link_targets(text: str) -> list[str]:
    """Destinations of inline links, images, and reference definitions, outside code; titles are left out."""
    lines = _unfenced(text)
    out = [m[1].strip("<>") for line in lines if (m := _DEFINITION.match(line))]
    body = re.sub(r"(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)", "", "\n".join(line for line in lines if not _DEFINITION.match(line)), flags=re.S)
    for m in re.finditer(r"\]\(", body):
        end = _closing(body, m.end() - 1, "()")
        if end < 0:
            continue
        inside = body[m.end() : end].strip()
        if inside[:1] == "<" and (close := inside.find(">")) > 0:
            out.append(inside[1:close])
        elif inside:
            out.append(inside.split(None, 1)[0])
    return out


def links(pages: DataFrame) -> DataFrame:
    """(id, text) -> (id, target): the files that a Markdown text links to, decoded and without anchor; addresses and anchors alone are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, unquote(t.partition("#")[0])) for k, text in enumerate(b.column(1).to_pylist()) if text for t in link_targets(text) if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", t) and not t.startswith("#")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k for k, _ in found], pa.int64())), pa.array([t for _, t in found], pa.string())], names=["id", "target"])

    own = pages.select("id", "text")
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, target string")


def broken_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Links to no file of (path)."""
    return links(pages).join(files.select(F.col("path").alias("target")), "target", "left_anti")


def same_rows(one: DataFrame, other: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    other = other.select(*one.columns)
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def match_artifacts(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(task, sha256) expected and found -> (task, problem): missing, unexpected, or of another digest."""
    both = tasks.select("task", F.col("sha256").alias("s1"), F.lit(True).alias("l")).join(artifacts.select("task", F.col("sha256").alias("s2"), F.lit(True).alias("r")), "task", "full")
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(~F.col("s1").eqNullSafe(F.col("s2")), "digest")
    return both.select("task", problem.alias("problem")).where("problem is not null")
