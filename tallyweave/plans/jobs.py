"""Saved scripts, their runs one at a time, and stored results."""

from __future__ import annotations

import json
import os
import re
import threading
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..operators.chart import ChartInfo
from ..sources.tables import fetched


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", name)


def error_position(message: str) -> tuple[int, int]:
    """(line, column) told by a message, -1 where none is."""
    m = re.search(r"<?line (\d+),? (?:column|pos) (\d+)>?", message) or re.search(r"\(line (\d+), pos (\d+)\)", message)
    return (int(m[1]), int(m[2])) if m else (-1, -1)


@dataclass
class Script:
    name: str
    text: str
    id: str = ""
    failure: str | None = None

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a script needs a name")
        self.id = slug(self.name)


@dataclass
class Result:
    id: int
    script: str
    lines: list[str] | None = None
    failure: str | None = None
    line: int = -1
    column: int = -1
    chart: dict = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.failure is None

    def preview(self, n: int = 5) -> list[str]:
        return (self.lines or [])[:n]


class ScriptStore:
    """Scripts and results in one JSON file of the driver, replaced as a whole; without a path they last as long as the object."""

    def __init__(self, path: str | None = None):
        self.path, self.scripts, self.results = path, {}, {}
        if path and os.path.exists(path):
            with open(path) as f:
                d = json.load(f)
            self.scripts = {s["id"]: Script(**s) for s in d["scripts"]}
            self.results = {r["id"]: Result(**r) for r in d["results"]}

    def save(self) -> None:
        if not self.path:
            return
        with open(self.path + ".tmp", "w") as f:
            json.dump({"scripts": [asdict(s) for s in self.list_scripts()], "results": [asdict(r) for r in self.list_results()]}, f)
        os.replace(self.path + ".tmp", self.path)

    def list_scripts(self) -> list[Script]:
        return sorted(self.scripts.values(), key=lambda s: s.name)

    def list_results(self) -> list[Result]:
        return sorted(self.results.values(), key=lambda r: r.id)

    def add(self, script: Script) -> None:
        if script.id in self.scripts:
            raise ValueError(f"there is a script {script.name!r}")
        self.scripts[script.id] = script
        self.save()

    def update(self, old_id: str, script: Script) -> None:
        if old_id not in self.scripts or (script.id != old_id and script.id in self.scripts):
            raise ValueError(f"cannot replace {old_id!r}")
        del self.scripts[old_id]
        self.scripts[script.id] = script
        self.save()

    def delete(self, id_: str) -> None:
        self.scripts.pop(id_, None)
        self.save()

    def delete_result(self, id_: int) -> None:
        self.results.pop(id_, None)
        self.save()

    def set_chart(self, id_: int, chart: dict) -> None:
        if not self.results[id_].ok:
            raise ValueError("a failure has no chart")
        ChartInfo.parse(chart)
        self.results[id_].chart = chart
        self.save()


class JobRunner:
    """Runs scripts on threads of their own, one at a time; of waiting ones the last asked runs first."""

    def __init__(self, spark: SparkSession, store: ScriptStore, most_lines: int = 1_000_000):
        self.spark, self.store, self.most_lines = spark, store, most_lines
        self._waiting: list[tuple[int, Script]] = []
        self._running: threading.Thread | None = None
        self._lock = threading.Lock()
        self.progress: dict[int, int] = {}

    def check(self, script: Script) -> Script:
        """Parse each statement; what fails is kept on the script."""
        script.failure = None
        for statement in self._statements(script.text):
            try:
                self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
            except Exception as e:
                script.failure = str(e).strip().splitlines()[0]
                break
        return script

    @staticmethod
    def _statements(text: str) -> list[str]:
        return [s.strip() for s in re.split(r";\s*(?:\n|$)", text) if s.strip()]

    def submit(self, script: Script) -> int:
        with self._lock:
            id_ = 1 + max([0, *self.store.results, *self.progress])
            self.progress[id_] = 0
            self._waiting.append((id_, script))
            self._next()
        return id_

    def _next(self) -> None:
        if self._running is None and self._waiting:
            self._running = threading.Thread(target=self._run, args=self._waiting.pop(), daemon=True)
            self._running.start()

    def _run(self, id_: int, script: Script) -> None:
        result, statements = Result(id_, script.id, lines=[]), self._statements(script.text)
        try:
            for n, statement in enumerate(statements):
                df = self.spark.sql(statement)
                if df.columns:
                    result.lines += fetched(df, self.most_lines - len(result.lines))
                self.progress[id_] = 100 * (n + 1) // len(statements)
        except Exception as e:
            result.lines, result.failure = None, str(e)
            result.line, result.column = error_position(str(e))
        with self._lock:
            self.store.results[id_] = result
            self.store.save()
            self._running = None
            self._next()

    def wait(self, timeout: float = 60) -> bool:
        """Until nothing runs or ``timeout`` seconds have passed; whether nothing runs."""
        end = time.monotonic() + timeout
        while (t := self._running) is not None and (left := end - time.monotonic()) > 0:
            t.join(left)
        return self._running is None
