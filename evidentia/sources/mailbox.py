"""A mailbox behind an interface of pages as a data source of Spark: filters on sender and time reach the mailbox, a day is read
page by page, and days are read side by side.

A client is any object that can be pickled with ``pages(sender, day) -> int`` (how many pages the mailbox lists for a sender, or for
all where that is None) and ``fetch(sender, day, page)``, which gives rows of ``SCHEMA``; a day is a ``datetime.date``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id string, sender string, received timestamp, payload string"


class Client(Protocol):
    def pages(self, sender: str | None, day: date) -> int: ...

    def fetch(self, sender: str | None, day: date, page: int) -> Iterable[tuple]: ...


@dataclass
class Day(InputPartition):
    """One day of the mailbox: what a task reads."""

    sender: str | None
    day: date

    def __post_init__(self):
        super().__init__((self.sender, self.day))


def _day(value) -> date:
    """The day of a timestamp in UTC, as the filters give it."""
    if isinstance(value, datetime):
        return (value if value.tzinfo is None else value.astimezone(UTC)).date()
    return value


class MailboxReader(DataSourceReader):
    """Days between the first and the last that the mailbox is asked for, which filters on ``received`` draw closer."""

    def __init__(self, client: Client, first: date, last: date):
        self.client, self.first, self.last, self.sender = client, first, last, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes the sender over; bounds of time choose days, and stay with Spark, which looks at the hours."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sender",) and self.sender is None:
                self.sender = f.value
                continue
            if f.__class__ in (GreaterThan, GreaterThanOrEqual, EqualTo) and f.attribute == ("received",):
                self.first = max(self.first, _day(f.value))
            if f.__class__ in (LessThan, LessThanOrEqual, EqualTo) and f.attribute == ("received",):
                bound = f.value - timedelta(microseconds=1) if isinstance(f, LessThan) else f.value
                self.last = min(self.last, _day(bound))
            yield f

    def partitions(self) -> list[Day]:
        return [Day(self.sender, self.first + timedelta(days=n)) for n in range((self.last - self.first).days + 1)]

    def read(self, partition: Day | None) -> Iterator[tuple]:
        if partition is None:
            return
        for page in range(self.client.pages(partition.sender, partition.day)):
            yield from self.client.fetch(partition.sender, partition.day, page)


def mailbox_source(client: Client) -> type[DataSource]:
    """The class of a data source ``mailbox`` with the options ``first`` and ``last``: the days that it has, as yyyy-mm-dd."""

    class MailboxSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mailbox"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> MailboxReader:  # noqa: ARG002
            return MailboxReader(client, date.fromisoformat(self.options["first"]), date.fromisoformat(self.options["last"]))

    return MailboxSource


def read_mailbox(spark: SparkSession, client: Client, first: date, last: date) -> DataFrame:
    """The mails of the days from ``first`` to ``last``. Times are UTC; equal mails on two pages stay two rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(mailbox_source(client))
    return spark.read.format("mailbox").options(first=first.isoformat(), last=last.isoformat()).load()
