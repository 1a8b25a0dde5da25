"""Scanning a filesystem into a listing, and writing a listing back.

Directories are walked level by level: each level's directories are listed by the tasks, so a wide tree is read in
parallel and no list of all files is made on the driver. The paths must be visible to all executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.functions.paths import path_included, strip_prefix
from snapweave.session import written

SCHEMA = "path string, parent string, name string, node_type string, size long, modified_time timestamp_ntz, mode int, owner_uid int, symlink_target string"
#: The seven kinds of nodes by file type bits.
KINDS = [(stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"), (stat.S_ISBLK, "block_device"), (stat.S_ISCHR, "char_device"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket")]


def node_of(path: str) -> tuple:
    """A listing row of a path; links are not followed, so a broken link is a row like any other."""
    s = os.lstat(path)
    kind = next((k for test, k in KINDS if test(s.st_mode)), "file")
    when = datetime(1970, 1, 1) + timedelta(microseconds=s.st_mtime_ns // 1000)
    return path, os.path.dirname(path), os.path.basename(path), kind, s.st_size if kind == "file" else 0, when, s.st_mode, s.st_uid, os.readlink(path) if kind == "symlink" else None


def scan_files(spark: SparkSession, roots: list[str], exclude: list[str] | None = None) -> DataFrame:
    """The listing of ``roots`` and all below them. A root that does not exist is an error; a root below another root is
    listed once; excluded directories are not entered."""
    tops = sorted({os.path.abspath(r) for r in roots})
    tops = [t for t in tops if not any(t != o and t.startswith(o.rstrip("/") + "/") for o in tops)]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for t in tops:
        if not os.path.lexists(t):
            raise FileNotFoundError(t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [node_of(os.path.join(p, n)) for p in pdf["path"] for n in sorted(os.listdir(p))]
            out = pd.DataFrame(rows, columns=columns)
            out["modified_time"] = pd.to_datetime(out["modified_time"])
            yield out

    keep = path_included(F.col("path"), None, exclude)
    level = spark.createDataFrame([node_of(t) for t in tops], SCHEMA).where(keep)
    out = level
    while True:
        level = written(level.where("node_type = 'directory'").select("path").repartition("path").mapInPandas(run, SCHEMA).where(keep), "listing")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def with_contents(spark: SparkSession, listing: DataFrame, roots: list[str]) -> DataFrame:
    """The listing with the bytes of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    files = files.select(F.regexp_replace(F.col("path"), "^file:", "").alias("path"), "content")
    return listing.join(files, "path", "left")


def write_files(nodes: DataFrame, target: str, prefix: str | None = None, policy: str = "fail") -> DataFrame:
    """Writes directories and files (path, node_type, content) below ``target``; (path, action) of each.

    ``prefix`` is stripped from the paths, and paths above it are left out. policy for files that exist: skip, overwrite
    or fail, which names the file as failed and leaves it. Nothing happens until the result is used."""
    if policy not in ("skip", "overwrite", "fail"):
        raise ValueError("policy must be skip, overwrite or fail")
    path = F.col("path") if prefix is None else strip_prefix(F.col("path"), prefix)
    df = nodes.select(path.alias("path"), "node_type", F.col("content").cast("binary").alias("content")).where("path is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            acts = []
            for p, kind, data in zip(pdf["path"], pdf["node_type"], pdf["content"]):
                to = os.path.join(target, p.lstrip("/"))
                if kind == "directory":
                    os.makedirs(to, exist_ok=True)
                    acts.append("directory")
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                if os.path.lexists(to) and policy != "overwrite":
                    acts.append("skipped" if policy == "skip" else "failed")
                    continue
                temporary = f"{to}.part-{os.getpid()}"
                with open(temporary, "wb") as f:
                    f.write(data or b"")
                os.replace(temporary, to)
                acts.append("written")
            yield pd.DataFrame({"path": pdf["path"], "action": acts})

    return df.mapInPandas(run, "path string, action string")
