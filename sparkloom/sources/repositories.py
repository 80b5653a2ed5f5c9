"""Source files of a folder or of a Git revision as DataFrames; file contents are read by the executors."""

from __future__ import annotations

import os
import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import EXCLUDED, EXTENSIONS, lines, safe_path, useful_path
from sparkloom.settings import DEFAULT, Settings

FILES = "path string, source string, content_sha string"


def _git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=60, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout


def allow_list(repo: str) -> list[str] | None:
    """Tracked and untracked, not ignored, paths; None outside of Git."""
    try:
        return [p for p in _git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "replace").split("\0") if p]
    except (ValueError, OSError):
        return None


def _kept(rows: DataFrame, settings: Settings) -> DataFrame:
    """path, source, content_sha, warning: too large or not UTF-8 files become warnings, too many an error."""
    rows = rows.where(useful_path(F.col("path")) & safe_path(F.col("path")))
    big, odd = F.col("length") > settings.max_file_bytes, ~F.is_valid_utf8(F.col("content").cast("string"))
    warning = F.when(big, F.concat(F.lit("too large: "), "path")).when(odd, F.concat(F.lit("not UTF-8: "), "path"))
    text = F.when(warning.isNull(), F.col("content").cast("string"))
    return rows.select("path", text.alias("source"), F.sha2(F.col("content"), 256).alias("content_sha"), warning.alias("warning"))


def _guarded(rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    files = rows.where("warning is null").drop("warning")
    n, total = files.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    if n > settings.max_files:
        raise ValueError(f"{n} files; at most {settings.max_files} are indexed")
    if total > settings.max_total_bytes:
        raise ValueError(f"{total} bytes; at most {settings.max_total_bytes} are indexed")
    return files, rows.where("warning is not null").select("warning")


def working_tree(spark: SparkSession, repo: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(files: path, source, content_sha; warnings) of a folder.

    Links are not followed.  Inside a Git working tree, ignored files are left out.
    """
    repo = os.path.realpath(repo)
    if not os.path.isdir(repo):
        raise ValueError("not a folder")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{repo}")
    prefix = F.lit(f"file:{repo}/")
    path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "file:/"), prefix, F.lit("")))
    rows = raw.select(path.alias("path"), "length", "content")
    allowed = allow_list(repo)
    real = []
    for d, folders, found in os.walk(repo):
        folders[:] = [f for f in folders if f not in EXCLUDED]  # folders that are never scanned are not entered
        real += [os.path.relpath(os.path.join(d, f), repo) for f in found if f.endswith(EXTENSIONS) and not os.path.islink(os.path.join(d, f))]
    names = real if allowed is None else sorted(set(real) & set(allowed))
    listing = spark.createDataFrame([(p,) for p in names], "path string")
    return _guarded(_kept(rows.join(listing, "path", "left_semi"), settings), settings)


def revision(spark: SparkSession, repo: str, rev: str, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(files, warnings) of a Git revision.  Regular files alone; names that look like options or are too long are errors.

    The listing is made here; blobs are read by ``git cat-file`` in batches, a partition each.
    """
    if rev.startswith("-") or len(rev) > 200 or not rev:
        raise ValueError("not a revision")
    repo = os.path.realpath(repo)
    commit = _git(repo, "rev-parse", "--verify", "--end-of-options", f"{rev}^{{commit}}").decode().strip()
    rows = []
    for entry in _git(repo, "ls-tree", "-r", "-l", "-z", commit).decode("utf-8", "replace").split("\0"):
        m = re.match(r"(100644|100755) blob (\w+) +(\d+)\t(.*)", entry, re.S)
        if m:
            rows.append((m[4], m[2], int(m[3])))
    listing = spark.createDataFrame(rows, "path string, blob string, length long")

    def read(batches):
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(blobs).encode(), capture_output=True, timeout=60, check=True).stdout
            at, contents = 0, []
            for _ in blobs:
                end = out.index(b"\n", at)
                size = int(out[at:end].split()[2])
                contents.append(out[end + 1 : end + 1 + size])
                at = end + 2 + size
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(contents, pa.binary())], schema=schema)

    wanted = listing.where(useful_path(F.col("path")) & (F.col("length") <= settings.max_file_bytes))
    big = listing.where(useful_path(F.col("path")) & (F.col("length") > settings.max_file_bytes)).select(F.concat(F.lit("too large: "), "path").alias("warning"))
    files, warnings = _guarded(_kept(wanted.mapInArrow(read, "path string, length long, content binary"), settings), settings)
    return files, warnings.unionByName(big)


def list_versions(spark: SparkSession, repo: str, registry: DataFrame | None = None) -> DataFrame:
    """name, kind, commit (and version_key from a registry): the working tree, HEAD, tags and the last twelve commits."""
    rows = [("working-tree", "working-tree", None)]
    try:
        rows.append(("HEAD", "head", _git(repo, "rev-parse", "HEAD").decode().strip()))
        rows += [(t, "tag", _git(repo, "rev-list", "-n", "1", t).decode().strip()) for t in _git(repo, "tag", "--sort=-creatordate").decode().split()]
        rows += [(c[:12], "commit", c) for c in _git(repo, "rev-list", "-n", "12", "HEAD").decode().split()]
    except ValueError:
        pass
    out = spark.createDataFrame(rows, "name string, kind string, commit string").dropDuplicates(["name"])
    return out if registry is None else out.join(registry.select("name", "version_key"), "name", "left")


def source_lines(files: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """path, line, text of a range of lines of one stored file; an unsafe path is an error."""
    if not path or path.startswith("/") or "\\" in path or ".." in path.split("/"):
        raise ValueError("unsafe path")
    return files.where(F.col("path") == path).select("path", F.posexplode(lines(F.col("source"))).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text").where(F.col("line").between(first, last))
