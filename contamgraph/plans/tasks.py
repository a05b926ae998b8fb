"""Task graph with code-keyed caching.

A task's result is fresh while its files exist and its stamp names the current
code: the source of its function and of the modules it lists, and the versions of
the libraries it declares.  A task whose parent failed does not run.
"""
from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Task:
    name: str
    run: Callable[[], None]
    needs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    libraries: tuple[str, ...] = ()


@dataclass
class Outcome:
    status: str  # ok, cached, failed, skipped
    seconds: float = 0.0
    error: str = ""


def code_key(task: Task) -> str:
    h = hashlib.sha256(inspect.getsource(task.run).encode())
    for name in sorted(task.modules):
        h.update(inspect.getsource(importlib.import_module(name)).encode())
    for name in sorted(task.libraries):
        try:
            h.update(f"{name}={importlib.import_module(name).__version__}".encode())
        except ImportError:
            h.update(f"{name}=none".encode())
    return h.hexdigest()[:16]


def exists(path: str) -> bool:
    """Whether a path exists, on any file system that the running session knows; local without one."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return os.path.exists(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def fresh(task: Task, stamps: Path) -> bool:
    stamp = stamps / f"{task.name}.json"
    if not task.outputs or not stamp.exists() or not all(map(exists, task.outputs)):
        return False
    return json.loads(stamp.read_text()).get("code") == code_key(task)


def run_all(tasks: list[Task], stamps: str | Path, force: bool = False) -> dict[str, Outcome]:
    stamps = Path(stamps)
    stamps.mkdir(parents=True, exist_ok=True)
    out: dict[str, Outcome] = {}
    for t in tasks:
        if any(out.get(n, Outcome("skipped")).status in ("failed", "skipped") for n in t.needs):
            out[t.name] = Outcome("skipped")
            continue
        if not force and fresh(t, stamps):
            out[t.name] = Outcome("cached")
            continue
        began = time.time()
        try:
            t.run()
        except Exception as e:  # one task's failure must not stop its independent siblings
            out[t.name] = Outcome("failed", time.time() - began, f"{type(e).__name__}: {e}")
            continue
        (stamps / f"{t.name}.json").write_text(json.dumps({"code": code_key(t)}))
        out[t.name] = Outcome("ok", time.time() - began)
    return out


@dataclass
class Roots:
    """Input and output folders; the environment may override them."""

    data: str = field(default_factory=lambda: os.environ.get("CONTAMGRAPH_DATA", ""))

    def require(self) -> str:
        if not self.data:
            raise FileNotFoundError("set CONTAMGRAPH_DATA or pass a data root")
        return self.data
