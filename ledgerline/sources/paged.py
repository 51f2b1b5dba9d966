"""Paged and batched web answers as a Spark data source, for batches and streams.

    spark.dataSource.register(PagedJson)
    spark.read.format("paged_json").option("url", "https://host/items?page={page}").option("pages", 40).load()
    spark.read.format("paged_json").option("url", "https://host/decode?ids={keys}").option("keys", "A;B;C").load()
    spark.readStream.format("paged_json").option("url", "https://host/items?page={page}").load()

One row a request: (page, keys, body, error). A request that fails for its quota
is tried again with growing pauses; another failure of a batch read, or an empty
answer, gives a null body and the error. A stream never skips a page: the failure
ends it, and after a restart it goes on with the page that failed."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerline.operators.workqueue import QuotaExhausted, with_backoff

SCHEMA = "page int, keys string, body string, error string"
#: Keys of one request.
BATCH = 50


class Requests(InputPartition):
    """What one task asks for: (page, keys) in order."""

    def __init__(self, asked: list[tuple[int | None, list[str]]]) -> None:
        super().__init__(None)
        self.asked = asked


def is_quota(error: Exception) -> bool:
    """A refusal for too many requests: 429, or 403 with a quota or rate reason."""
    if not isinstance(error, urllib.error.HTTPError):
        return False
    return error.code == 429 or (error.code == 403 and any(w in str(getattr(error, "said", "")).lower() for w in ("quota", "ratelimit", "rate limit")))


class _Asker:
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.batch = int(options.get("batch", BATCH))
        self.timeout = float(options.get("timeout", 30))
        self.attempts = int(options.get("attempts", 5))
        self.delay = float(options.get("delay", 1.0))
        #: Requests a second of all tasks together, and tasks that share them.
        self.rate = float(options.get("rate", 0))
        self.tasks = max(1, int(options.get("tasks", 8)))

    def fetch(self, page: int | None, keys: list[str]) -> str | None:
        """The body of an answer; None for an empty one."""
        url = self.url.replace("{page}", str(page)).replace("{keys}", urllib.parse.quote(";".join(keys), safe=";"))

        def call() -> str:
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as error:
                error.said = error.read().decode("utf-8", "replace")
                raise

        return with_backoff(call, is_quota, self.attempts, self.delay) or None

    def rows(self, part: Requests, strict: bool) -> Iterator[tuple]:
        """Rows of a task's requests, spaced so that all tasks keep to the rate."""
        pause, before = (self.tasks / self.rate if self.rate else 0.0), None
        for page, keys in part.asked:
            if before is not None and pause:
                time.sleep(max(0.0, before + pause - time.monotonic()))
            before = time.monotonic()
            try:
                body, error = self.fetch(page, keys), None
            except (OSError, QuotaExhausted) as failure:
                if strict:
                    raise
                body, error = None, f"{type(failure).__name__}: {failure}"
            yield page, ";".join(keys) or None, body, error


class _BatchReader(_Asker, DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        _Asker.__init__(self, options)
        keys = [k for k in dict.fromkeys(k.strip() for k in options.get("keys", "").split(";")) if k]
        pages = int(options.get("pages", 0))
        self.asked = [(None, keys[i : i + self.batch]) for i in range(0, len(keys), self.batch)] if keys else [(p, []) for p in range(1, pages + 1)]

    def partitions(self) -> list[Requests]:
        return [Requests(self.asked[i :: self.tasks]) for i in range(min(self.tasks, len(self.asked)))]

    def read(self, partition: Requests) -> Iterator[tuple]:
        return self.rows(partition, strict=False)


class _StreamReader(_Asker, DataSourceStreamReader):
    """Pages as they appear; the offset is the last page that is there."""

    def __init__(self, options: dict[str, str]) -> None:
        _Asker.__init__(self, options)
        self.most = int(options.get("pages_per_batch", 100))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        """Looks for the next pages, some at a time: a page that is not found is
        the end for now."""
        last = self.seen
        while last < self.seen + self.most:
            try:
                self.fetch(last + 1, [])
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    break
            except (urllib.error.URLError, FileNotFoundError) as error:
                if isinstance(getattr(error, "reason", error), FileNotFoundError) or "No such file" in str(error):
                    break
                raise
            last += 1
        self.seen = last
        return {"page": last}

    def partitions(self, start: dict, end: dict) -> list[Requests]:
        self.seen = max(self.seen, end["page"])
        pages = [(p, []) for p in range(start["page"] + 1, end["page"] + 1)]
        return [Requests(pages[i :: self.tasks]) for i in range(min(self.tasks, len(pages)))]

    def read(self, partition: Requests) -> Iterator[tuple]:
        return self.rows(partition, strict=True)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end["page"])


class PagedJson(DataSource):
    """Options: url with {page} or {keys}; pages or keys (joined by ;), batch,
    rate (requests a second of all tasks), tasks, attempts, delay, timeout,
    pages_per_batch."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
