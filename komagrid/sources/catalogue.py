"""A paged JSON catalogue as a Spark data source: one partition per page of results, equality filters sent to the service.

The transport is a function from path and parameters to a payload. ``FileTransport`` serves recorded payloads from a
folder; ``http_transport`` asks a service with retries, back-off and a least interval between requests.
"""

from __future__ import annotations

import json
import math
import threading
import time
import warnings
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

PAGE, MOST = 500, 10_000
INTERVAL, RETRIES = 0.25, 2
# All ratings; without them the service leaves titles out.
RATINGS = ["safe", "suggestive", "erotica", "pornographic"]
SCHEMA = "id string, language string, payload string"


class CatalogueError(RuntimeError):
    """The service has no such record, or refused."""


class FileTransport:
    """Payloads from ``<root>/<path>.json``: a list of records under 'data', cut to offset and limit here."""

    def __init__(self, root: str) -> None:
        self.root = root

    def __call__(self, path: str, params: dict[str, Any]) -> dict:
        file = Path(self.root) / f"{path.strip('/')}.json"
        if not file.exists():
            raise CatalogueError(f"not found: {path}")
        payload = json.loads(file.read_text(encoding="utf-8"))
        if isinstance(payload.get("data"), list):
            rows = payload["data"]
            wanted = params.get("translatedLanguage[]")
            if wanted:
                rows = [r for r in rows if r.get("attributes", {}).get("translatedLanguage") in wanted]
            offset, limit = int(params.get("offset", 0)), int(params.get("limit", PAGE))
            payload = payload | {"data": rows[offset : offset + limit], "total": len(rows)}
        return payload


class Turns:
    """Requests of one process at least ``interval`` apart, whichever thread or reader makes them.

    A reader of ``n`` partitions takes ``n`` times the interval, so that all its tasks together keep the service's pace.
    """

    guard, next_free = threading.Lock(), 0.0

    @classmethod
    def wait(cls, interval: float) -> None:
        with cls.guard:
            now = time.monotonic()
            due, cls.next_free = max(now, cls.next_free), max(now, cls.next_free) + interval
        time.sleep(max(0.0, due - now))


def pause_asked(headers: Any, attempt: int, now: Callable[[], float] = time.time) -> float:
    """Seconds to wait before the next attempt: until the time the service names, as long as it asks, or 1, 2, 4 and so on."""
    if until := headers.get("X-RateLimit-Retry-After"):
        return max(0.0, float(until) - now())
    return float(headers.get("Retry-After") or 1 << attempt)


def http_transport(base: str, interval: float = INTERVAL, retries: int = RETRIES, timeout: float = 30.0) -> Callable[[str, dict[str, Any]], dict]:
    """A transport over HTTP: each request takes its turn; what is said to pass (429, 5xx, no answer) is asked again."""

    def ask(path: str, params: dict[str, Any]) -> tuple[int, Any]:
        import requests

        Turns.wait(interval)
        try:
            answer = requests.get(base + path, params=params, timeout=timeout)
        except requests.RequestException as e:
            return 0, e
        return answer.status_code, answer

    def get(path: str, params: dict[str, Any]) -> dict:
        passing = lambda status: status in (0, 429) or status >= 500
        status, answer = ask(path, params)
        for attempt in range(retries):
            if not passing(status):
                break
            time.sleep(pause_asked(getattr(answer, "headers", None) or {}, attempt))
            status, answer = ask(path, params)
        if 200 <= status < 300:
            return answer.json()
        raise CatalogueError({0: f"no answer: {answer}", 404: f"not found: {path}"}.get(status, f"{status}: {path}"))

    return get


def fetch_page(url: str, resolve: Callable[[], str] | None = None, get: Callable[[str], bytes] | None = None) -> bytes:
    """A page's bytes; where that fails, once more from the address that ``resolve`` finds anew."""
    get = get or _bytes
    try:
        return get(url)
    except Exception:
        if resolve is None:
            raise
    return get(resolve())


def _bytes(url: str) -> bytes:
    import requests

    answer = requests.get(url, timeout=30.0)
    answer.raise_for_status()
    return answer.content


def download(pages: DataFrame, resolve: Callable[[str, int], str] | None = None, get: Callable[[str], bytes] | None = None) -> DataFrame:
    """(chapter_id, page, content, error) of pages (chapter_id, page, url), fetched by the executors.

    ``resolve``: chapter and page to a fresh address, asked once where a page's address fails. A page's failure is a
    value of its row; the others go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chapter, page, url in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                content = error = None
                try:
                    content = fetch_page(url, None if resolve is None else lambda c=chapter, p=page: resolve(c, p), get)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pydict({"chapter_id": pa.array([chapter], pa.string()), "page": pa.array([page], pa.int32()), "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    rows = pages.select(F.col("chapter_id").cast("string"), F.col("page").cast("int"), F.col("url").cast("string"))
    return rows.mapInArrow(run, "chapter_id string, page int, content binary, error string")


class Offset(InputPartition):
    def __init__(self, offset: int) -> None:
        super().__init__(offset)
        self.offset = offset


class CatalogueReader(DataSourceReader):
    """Reads a feed page by page; the first page tells how many there are, up to ``MOST`` records."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.options = options["path"], dict(options)
        self.languages: list[str] = []
        self.tasks = 1

    def transport(self, path: str, params: dict[str, Any]) -> dict:
        if "root" in self.options:
            return FileTransport(self.options["root"])(path, params)
        return http_transport(self.options["base"], self.tasks * float(self.options.get("interval", INTERVAL)))(path, params)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("language",):
                self.languages.append(f.value)
            else:
                yield f

    def _params(self, offset: int, limit: int = PAGE) -> dict[str, Any]:
        params: dict[str, Any] = {"limit": limit, "offset": offset, "includeExternalUrl": 0, "includeEmptyPages": 0, "includeFuturePublishAt": 0, "includes[]": ["scanlation_group"], "contentRating[]": RATINGS, "order[chapter]": "asc"}
        if self.languages:
            params["translatedLanguage[]"] = self.languages
        return params

    def partitions(self) -> list[Offset]:
        if len(set(self.languages)) > 1:
            return [Offset(-1)]
        total = int(self.transport(self.path, self._params(0, 1)).get("total", 0))
        if total > MOST:
            warnings.warn(f"{self.path} has {total} records, of which the service gives {MOST}; filter by language to see more", stacklevel=2)
        self.tasks = max(1, math.ceil(min(total, MOST) / PAGE))
        return [Offset(i * PAGE) for i in range(self.tasks)]

    def read(self, partition: Offset) -> Iterator[tuple]:
        if partition.offset < 0:
            return
        for item in self.transport(self.path, self._params(partition.offset)).get("data", []):
            yield item.get("id"), item.get("attributes", {}).get("translatedLanguage"), json.dumps(item, ensure_ascii=False)


class CatalogueSource(DataSource):
    """``spark.read.format("catalogue").option("root", ...).load("manga/<id>/feed")``: id, language, payload."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> CatalogueReader:
        return CatalogueReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)
