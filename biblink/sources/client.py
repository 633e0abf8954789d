"""Requests to the online indexes: paced, capped, retried, and given up for good at a quota wall.

All requests to one index run in one task, so that its limits hold for the whole
job: the indexes' limits, not the cluster, bound the speed.  A request that
fails gives a row with an error and stops nothing.
"""

from __future__ import annotations

import random
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Requests at once and seconds between two, by index; texts of a quota wall.
CAPS = {"openalex": 4, "crossref": 4, "europepmc": 6, "pubmed": 3, "semanticscholar": 1}
INTERVALS = {"openalex": 0.05, "crossref": 0.06, "europepmc": 0.05, "pubmed": 0.35, "semanticscholar": 1.10}
DEFAULT_CAP, DEFAULT_INTERVAL = 4, 0.05
QUOTA_WORDS = ("insufficient budget", "add funds", "quota exceeded", "payment required")
RETRYABLE = (429, 500, 502, 503, 504)
ATTEMPTS, FIRST_DELAY, JITTER = 4, 1.0, 0.4
#: Indexes that take part only if a key is given.
NEEDS_KEY = ("semanticscholar",)
TIMEOUT = 30.0

#: ``transport(url, headers)`` gives a status and a text, or raises.
Transport = Callable[[str, dict], tuple[int, str]]


def quota_wall(status: int, text: str) -> bool:
    """Not congestion: waiting can't help."""
    return status in (402, 429) and any(w in text.lower() for w in QUOTA_WORDS)


def retryable(status: int) -> bool:
    return status in RETRYABLE


def over_http(url: str, headers: dict) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


class Index:
    """One index's state: when the next request may start, and whether it still answers."""

    def __init__(self, name: str, transport: Transport, clock=time.monotonic, sleep=time.sleep, rng=random.random):
        self.name, self.transport, self.clock, self.sleep, self.rng = name, transport, clock, sleep, rng
        self.cap, self.interval = CAPS.get(name, DEFAULT_CAP), INTERVALS.get(name, DEFAULT_INTERVAL)
        self.disabled: str | None = None
        self._next, self._lock = 0.0, threading.Lock()

    def _pace(self) -> None:
        with self._lock:
            wait = self._next - self.clock()
            if wait > 0:
                self.sleep(wait)
            self._next = max(self._next, self.clock()) + self.interval

    def get(self, url: str, headers: dict | None = None) -> tuple[str | None, str | None]:
        """The answer's text, or what kept it from coming; an unknown record is no error."""
        delay, why = FIRST_DELAY, None
        for attempt in range(ATTEMPTS):
            if self.disabled:
                return None, f"disabled: {self.disabled}"
            try:
                self._pace()
                status, text = self.transport(url, headers or {})
                if quota_wall(status, text):
                    self.disabled = f"HTTP {status}: metered quota exhausted"
                    return None, f"disabled: {self.disabled}"
                if not retryable(status):
                    if status >= 400:
                        return None, None if status == 404 else f"HTTP {status} {text[:200]}"
                    return text, None
                why = f"HTTP {status} {text[:180]}"
            except Exception as e:  # an index may fail in any way
                why = f"{type(e).__name__}: {e}"
            if attempt < ATTEMPTS - 1:
                self.sleep(delay + self.rng() * JITTER)
                delay *= 2
        return None, f"gave up: {why}"

    def all(self, urls: list[str], headers: dict | None = None) -> list[tuple[str | None, str | None]]:
        with ThreadPoolExecutor(self.cap) as pool:
            return list(pool.map(lambda u: self.get(u, headers), urls))


def enabled(keys: dict[str, str] | None = None) -> list[str]:
    """Indexes that take part: those that need a key only with one."""
    return [name for name in CAPS if name not in NEEDS_KEY or (keys or {}).get(name)]


def request_url(base: str, params: dict[str, str]) -> str:
    return base + ("?" + urllib.parse.urlencode(params) if params else "")


def fetch(requests: DataFrame, transport: Transport = over_http, keys: dict[str, str] | None = None, progress=None) -> DataFrame:
    """``requests(id, provider, url)`` to ``(id, provider, json, error)``.

    Requests to indexes that don't take part give neither.  ``progress`` is an
    accumulator that counts finished requests.
    """
    names = enabled(keys)
    kind = requests.schema["id"].dataType.simpleString()

    def run(batches):
        indexes: dict[str, Index] = {}
        for batch in batches:
            rows = batch.to_pylist()
            answers: dict[int, tuple[str | None, str | None]] = {}
            for name in sorted({r["provider"] for r in rows} & set(names)):
                index = indexes.setdefault(name, Index(name, transport))
                mine = [i for i, r in enumerate(rows) if r["provider"] == name]
                answers |= zip(mine, index.all([rows[i]["url"] for i in mine]))
            if progress is not None:
                progress.add(len(rows))
            found = [answers.get(i, (None, None)) for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["id", "provider", "json", "error"])

    # one partition for each index: its pace and its cap hold over all of its requests
    dealt = requests.select("id", "provider", "url").repartitionByRange(len(CAPS), F.col("provider"))
    return dealt.mapInArrow(run, f"id {kind}, provider string, json string, error string")


@contextmanager
def cancellable(spark: SparkSession, group: str):
    """Jobs started inside form a group; the yielded function cancels them, from any thread."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
