"""Pages and JSON fetched as a table, at a bounded rate, with failures as rows."""

from __future__ import annotations

import importlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TIMEOUT = 10.0
RETRIES = 3


class Pacer:
    """Pauses between requests that hold a rate: longer by the overshoot when requests come too fast, a little shorter when they come below nine tenths of it."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.pause, self.began, self.done = 1.0 / rate, clock(), 0

    def wait(self) -> None:
        self.sleep(self.pause)
        self.done += 1
        elapsed = self.clock() - self.began
        if elapsed < 1.0:
            return
        now = self.done / elapsed
        if now > self.rate:
            self.pause += 0.001 + 0.01 * (now - self.rate) / self.rate
        elif now < 0.9 * self.rate:
            self.pause = max(0.0, self.pause - 0.002)
        self.began, self.done = self.clock(), 0


@dataclass(frozen=True)
class Answer:
    status: int
    body: str | None
    retry_after: float | None = None


def over_http(url: str, agent: str = "filigrane") -> Answer:
    """One GET. Status 0 stands for no answer at all."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT) as r:
            return Answer(r.status or 200, r.read().decode("utf-8", "replace"))
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After", "") if e.headers else ""
        return Answer(e.code, None, float(after) if after.isdigit() else None)
    except (OSError, ValueError):
        return Answer(0, None)


def fetched(url: str, pacer: Pacer, get: Callable[[str], Answer] = over_http, retries: int = RETRIES) -> Answer:
    """The answer to a url. After 429 with a Retry-After it asks again, at most so many times; any other failure has no body."""
    for left in range(retries, -1, -1):
        pacer.wait()
        answer = get(url)
        if answer.status != 429 or answer.retry_after is None or not left:
            break
        pacer.sleep(answer.retry_after)
    return answer if answer.status == 200 else Answer(answer.status, None)


class FetchedPages(DataSource):
    """(url, status, body) of the urls of a text file, one a line.

    Options: path; rate, requests a second over all tasks; tasks; get, "module:function" in place of HTTP. A page that fails is a row without a body."""

    @classmethod
    def name(cls) -> str:
        return "filigrane_fetched"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Fetcher(self.options["path"], float(self.options.get("rate", "8")), int(self.options.get("tasks", "1")), self.options.get("get", f"{__name__}:over_http"))


class _Fetcher(DataSourceReader):
    def __init__(self, path: str, rate: float, tasks: int, get: str) -> None:
        self.path, self.rate, self.tasks, self.get = path, rate, tasks, get

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.tasks)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.get.partition(":")
        get, pacer = getattr(importlib.import_module(module), name), Pacer(self.rate / self.tasks)
        with open(self.path) as lines:
            for k, line in enumerate(lines):
                if k % self.tasks == partition.value and line.strip():
                    answer = fetched(line.strip(), pacer, get)
                    yield line.strip(), answer.status, answer.body
