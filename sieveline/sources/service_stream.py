"""A service that is read id by id, as a streaming source: spark.readStream.format("paged_service")."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .adapters import ATTEMPTS, EMPTY_RUN, PAGE_IDS


class Page(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class ServiceReader(DataSourceStreamReader):
    """The offset is the last id that holds anything, so that a stream that was stopped goes on behind the last id of its last whole batch."""

    def __init__(self, options: dict[str, str]):
        self.name, self.argument = options["fetch"], options.get("argument")
        self.begin, self.page = int(options.get("first", 1)), int(options.get("page", PAGE_IDS))
        self.attempts, self.empty = int(options.get("attempts", ATTEMPTS)), int(options.get("empty", EMPTY_RUN))

    def fetch(self) -> Callable[[int], str | None]:
        module, _, function = self.name.partition(":")
        call = getattr(importlib.import_module(module), function)
        return call if self.argument is None else lambda i: call(i, self.argument)

    def asked(self, call: Callable[[int], str | None], i: int) -> tuple[str | None, str | None]:
        """(payload, error) of an id after all attempts."""
        error = None
        for _ in range(self.attempts):
            try:
                return call(i), None
            except Exception as e:  # noqa: BLE001  the caller's service may raise anything
                error = str(e) or type(e).__name__
        return None, error

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.begin - 1}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last id: found by steps that double, then by halving, each asking whether one of `empty` ids in a row holds anything. About as many questions as the last id has bits, where few ids are empty."""
        call = self.fetch()

        def alive(i: int) -> bool:
            return any(self.asked(call, k) != (None, None) for k in range(i, i + self.empty))

        low, step = self.begin - 1, 1  # the last id is low or above
        while alive(low + step):
            low, step = low + step, 2 * step
        high = low + step  # nothing from here on
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if alive(mid) else (low, mid)
        return {"id": high - 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["id"] + 1, end["id"]
        return [Page(a, min(a + self.page - 1, last)) for a in range(first, last + 1, self.page)]

    def read(self, partition: Page) -> Iterator[tuple[int, str | None, str | None]]:
        call = self.fetch()
        for i in range(partition.first, partition.last + 1):
            payload, error = self.asked(call, i)
            if payload is not None or error is not None:
                yield i, payload, error


class PagedService(DataSource):
    """Options: fetch (module:function of an id, that returns a payload or None), argument (passed on to it), first, page (ids of a task), attempts, and empty: a service ends where so many ids in a row hold nothing; shorter gaps are passed over. An id whose attempts all fail has a row with the error."""

    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        return "message_id long, payload string, error string"

    def streamReader(self, schema: object) -> ServiceReader:  # noqa: N802
        return ServiceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedService)
