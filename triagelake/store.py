"""Runs: a folder with one Parquet table per stage, and a manifest whose hashes chain the stages."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from triagelake.settings import Settings

STAGES = ("raw", "normalised", "tiers", "correlated", "actions")


class LimitExceeded(RuntimeError):
    """A run has used more disk or time than it may."""


def _remote(path: str) -> bool:
    return re.match(r"^[a-z][a-z0-9+.-]+:", path) is not None


def _hadoop(path: str):
    """The JVM's file system and path object, for folders that only Spark's readers can open."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("a run on a remote file system needs a Spark session")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at, jvm


def read_text(path: str) -> str | None:
    """A small file's text, or null if there is none."""
    if not _remote(path):
        return Path(path).read_text(encoding="utf-8") if Path(path).exists() else None
    fs, at, jvm = _hadoop(path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replace a small file by a rename, so that a reader sees the old one or the new one, or for a moment none on a remote file system."""
    new = f"{path}.{uuid.uuid4().hex}.new"
    if not _remote(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(new).write_text(text, encoding="utf-8")
        Path(new).replace(path)
        return
    fs, at, jvm = _hadoop(path)
    staged = jvm.org.apache.hadoop.fs.Path(new)
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(staged, at):
        raise OSError(f"could not replace {path}")


def size(path: str) -> int:
    """Bytes under a folder; links to elsewhere are not followed."""
    if _remote(path):
        fs, at, _ = _hadoop(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, files in os.walk(path) for f in files if not os.path.islink(os.path.join(d, f)))


class Run:
    """The manifest is small; it lies beside the tables, on whatever file system Spark writes to."""

    def __init__(self, folder: str, limits: Settings | None = None):
        self.folder, self.limits = folder.rstrip("/"), limits or Settings()
        self.manifest = f"{self.folder}/run.json"

    def load(self) -> dict:
        text = read_text(self.manifest)
        return {"stages": {}} if text is None else json.loads(text)

    def save(self, state: dict) -> None:
        write_text(self.manifest, json.dumps(state, indent=2, sort_keys=True))

    def check(self, stage: str) -> None:
        """After a stage: raise, and say so in the manifest, if the run is over its disk or time."""
        state = self.load()
        used, took = size(self.folder), time.time() - state.setdefault("began", time.time())
        over = [f"{name}: {x:.0f} > {most}" for name, x, most in (("run disk", used, self.limits.max_run_disk_bytes), ("run seconds", took, self.limits.max_run_seconds)) if x > most]
        state["resources"] = {"disk_bytes": used, "elapsed_seconds": round(took, 3), "checked_after": stage}
        if over:
            state |= {"status": "failed", "errors": [*state.get("errors", []), {"stage": stage, "reason": "; ".join(over)}]}
        self.save(state)
        if over:
            raise LimitExceeded("; ".join(over))

    def fail(self, stage: str, error: Exception) -> None:
        """What was made from a failed stage is no longer valid; the manifest says why."""
        state, at = self.load(), STAGES.index(stage)
        state["stages"] = {s: v for s, v in state["stages"].items() if STAGES.index(s) < at}
        state |= {"status": "failed", "errors": [*state.get("errors", []), {"stage": stage, "reason": f"{type(error).__name__}: {str(error)[:2000]}"}]}
        self.save(state)

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def digest(self, df: DataFrame) -> str:
        """Of a table's rows, whatever their order: count and sum of row hashes."""
        from pyspark.sql import functions as F

        cols = [F.to_json(F.struct(c)) for c in sorted(df.columns)]
        row = df.agg(F.count("*"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
        return hashlib.sha256(f"{row[0]}|{row[1]}".encode()).hexdigest()

    def write(self, stage: str, df: DataFrame) -> DataFrame:
        """Write a stage; what was made from an earlier version of it is no longer valid."""
        state = self.load()
        state.setdefault("began", time.time())
        self.save(state)
        try:
            df.write.mode("overwrite").parquet(self.path(stage))
            out = self.read(df.sparkSession, stage)
            digest = self.digest(out)
        except Exception as e:
            self.fail(stage, e)
            raise
        state, at = self.load(), STAGES.index(stage)
        before = state["stages"].get(STAGES[at - 1], {}).get("sha256") if at else None
        state["stages"] = {s: v for s, v in state["stages"].items() if STAGES.index(s) < at}
        state["stages"][stage] = {"sha256": digest, "input": before}
        state["status"] = "complete" if stage == STAGES[-1] else "running"
        self.save(state)
        self.check(stage)
        return out

    def read(self, spark: SparkSession, stage: str) -> DataFrame:
        return spark.read.parquet(self.path(stage))

    def complete(self, spark: SparkSession) -> bool:
        """Whether every stage is there, made from the one before it, and unchanged since."""
        stages, before = self.load()["stages"], None
        for s in STAGES:
            if s not in stages or stages[s]["input"] != before or self.digest(self.read(spark, s)) != stages[s]["sha256"]:
                return False
            before = stages[s]["sha256"]
        return True
