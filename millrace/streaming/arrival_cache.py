"""State of some orders in the cached join.

Refers to nothing else in this package, so it can be sent to Python workers whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Arrival(NamedTuple):
    order_key: int | None
    line_id: str | None
    record: str


class Pair(NamedTuple):
    header: str
    line: str


class ArrivalCache(StatefulProcessor):
    """Keeps the headers and the early lines of a group of orders as opaque JSON text.

    Rows are handled chunk by chunk and early lines live in a map state, so an order of any size is never held in memory at
    once.  Headers live in pages of ``PAGE`` neighbouring orders, as a request to the state costs more than a header; each
    keeps the time of its own last write, from which it expires.
    """

    CHUNK = 10_000
    PAGE = 16

    def __init__(self, ttl_ms: int | None):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = "orders array<bigint>, written array<bigint>, records array<string>"
        self._headers = handle.getMapState("headers", "page bigint", page, self._ttl_ms)
        self._lines = handle.getMapState("lines", "order_key bigint, id string", "record string", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Arrival], timerValues) -> Iterator[Pair]:
        now = timerValues.getCurrentProcessingTimeInMs() if self._ttl_ms else 0
        rows = ((row.order_key, row.line_id, row.record) for row in rows)
        while chunk := list(islice(rows, self.CHUNK)):
            sent: dict[int | None, list[str]] = {}
            for order, line_id, record in chunk:
                if line_id is None:
                    sent.setdefault(order, []).append(record)
            kept = self._kept(now)
            self._keep(kept, sent, now)
            if sent:
                for (order, _), (line,) in self._lines.iterator():
                    for header in sent.get(order, ()):
                        yield Pair(header, line)
            for order, line_id, record in chunk:
                if line_id is None:
                    continue
                header = kept.get(order)
                if header is not None:
                    yield Pair(header[1], record)
                else:
                    self._lines.updateValue((order, line_id), (record,))

    def _kept(self, now: int) -> dict[int | None, tuple[int, str]]:
        """The headers of the group that have not expired, with the time of their last write."""
        pages = [zip(*page, strict=True) for _, page in self._headers.iterator()]
        return {
            order: (written, record)
            for page in pages
            for order, written, record in page
            if not self._ttl_ms or written + self._ttl_ms > now
        }

    def _keep(self, kept: dict[int | None, tuple[int, str]], sent: dict[int | None, list[str]], now: int) -> None:
        """Takes the last header sent for each order over into ``kept`` and the state."""
        kept |= {order: (now, records[-1]) for order, records in sent.items()}
        changed = {self._page(order) for order in sent}
        pages: dict[int, list[tuple[int | None, int, str]]] = {page: [] for page in changed}
        for order, (written, record) in kept.items():
            if (page := self._page(order)) in changed:
                pages[page].append((order, written, record))
        for page, headers in pages.items():
            self._headers.updateValue((page,), tuple(list(column) for column in zip(*headers, strict=True)))

    def _page(self, order: int | None) -> int:
        return -1 if order is None else order // self.PAGE

    def close(self) -> None:
        pass


class ArrivalFrames(ArrivalCache):
    """The same for frames: a group's orders share them."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pairs = super().handleInputRows(key, self._arrivals(rows), timerValues)
        while chunk := list(islice(pairs, self.CHUNK)):
            yield pd.DataFrame(chunk, columns=list(Pair._fields))

    def _arrivals(self, frames: Iterator[pd.DataFrame]) -> Iterator[Arrival]:
        # Text columns: a null would turn the numbers of a frame into floats.
        for frame in frames:
            for order, line_id, record in zip(*(frame[name].tolist() for name in Arrival._fields), strict=True):
                yield Arrival(
                    int(order) if isinstance(order, str) else None, line_id if isinstance(line_id, str) else None, record
                )
