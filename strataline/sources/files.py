"""Source trees as tables: relative paths first, contents only of what the path rules admit."""

from __future__ import annotations

import io
import os
import shutil
import signal
import subprocess
import tempfile
import zipfile
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_EXCLUDES, language_of, path_included, source_kind, source_normalized


def tree(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = DEFAULT_EXCLUDES, names: str | None = None) -> DataFrame:
    """(path relative to ``root``, content) of the admitted files below ``root``; ``names`` is a glob of file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if names:
        reader = reader.option("pathGlobFilter", names)
    base = os.path.abspath(root).rstrip("/") if "://" not in root else root.rstrip("/")
    plain = F.regexp_replace("path", "^file:/*", "/") if "://" not in root else F.col("path")
    rows = reader.load(root).select(F.substring(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 20).alias("path"), "content")
    return rows.where(path_included(F.col("path"), include, exclude))


def texts(files: DataFrame) -> DataFrame:
    """(path, text) without a byte-order mark."""
    return files.select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("text"))


def detected_language(files: DataFrame, key: str) -> DataFrame:
    """The one language of the files under each ``key``; null if there are several or none."""
    rows = files.withColumn("_l", language_of(F.col("path"))).groupBy(key).agg(F.min("_l").alias("lo"), F.max("_l").alias("hi"))
    return rows.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("language"))


def check_request(path: str | None, repo_url: str | None) -> None:
    """Exactly one source must be given."""
    if bool((path or "").strip()) == bool((repo_url or "").strip()):
        raise ValueError("give exactly one of a path and a repository URL")


def meant(spark: SparkSession, path: str | None, repo_url: str | None) -> tuple[str | None, str | None]:
    """(path, URL) that a source means, by the rules of ``source_kind``; what exists as a path is one."""
    text = (path or "").strip() or (repo_url or "").strip()
    row = spark.range(1).select(source_kind(F.lit(text)).alias("kind"), source_normalized(F.lit(text)).alias("text")).first()
    if row.kind == "file":
        return row.text, None
    if os.path.exists(text) and not repo_url:
        return text, None
    return (None, row.text) if row.kind in ("url", "shorthand") or repo_url else (text, None)


def check_loaded(projects: int, failures: list[str], root: str) -> None:
    """Failures count only where nothing was loaded."""
    if not projects and failures:
        raise RuntimeError("\n".join([f"nothing could be loaded from {root}", *(f"- {f}" for f in failures)]))


@contextmanager
def workdir(prefix: str = "strataline-", keep: bool = False) -> Iterator[str]:
    """A temporary folder of the driver, removed afterwards."""
    path = tempfile.mkdtemp(prefix=prefix)
    try:
        yield path
    finally:
        if not keep:
            shutil.rmtree(path, ignore_errors=True)


def git_arguments(url: str, target: str, branch: str | None = None, depth: int | None = 1) -> list[str]:
    """The arguments of a shallow clone."""
    out = ["clone"]
    if depth:
        out += ["--depth", str(depth)]
    if branch:
        out += ["-b", branch, "--single-branch"]
    return [*out, url, target]


def clone(url: str, target: str, branch: str | None = None, timeout: float = 300) -> str:
    """Clones a repository into ``target``; a run beyond ``timeout`` seconds is ended."""
    code, said = run(["git", *git_arguments(url, target, branch)], timeout)
    if code:
        raise RuntimeError(f"git clone failed ({code}): {said.strip()}")
    return target


def run(command: list[str], timeout: float) -> tuple[int, str]:
    """Exit code and error output of a command; at the timeout it ends with all processes it started."""
    with subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"}, start_new_session=True) as process:
        try:
            _, said = process.communicate(timeout=timeout)
        except BaseException:
            os.killpg(process.pid, signal.SIGKILL)  # the group that start_new_session made
            process.wait()
            raise
    return process.returncode, said


def unzip(data: bytes, target: str) -> list[str]:
    """Unpacks an archive below ``target``; entries that would land elsewhere are skipped."""
    base, out = os.path.realpath(target), []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for entry in archive.infolist():
            to = os.path.realpath(os.path.join(base, entry.filename.replace("\\", "/")))
            if entry.is_dir() or not to.startswith(base + os.sep):
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with archive.open(entry) as a, open(to, "wb") as b:
                shutil.copyfileobj(a, b)
            out.append(os.path.relpath(to, base))
    return out
