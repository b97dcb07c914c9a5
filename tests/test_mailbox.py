"""The paged mailbox as a data source: what is asked of it, and what comes of it."""

import glob
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from evidentia.sources.files import mailbox
from evidentia.sources.mailbox import read_mailbox

FIRST, LAST = date(2025, 3, 1), date(2025, 3, 20)


class Folder:
    """Mails by rule, and a file for each page that is fetched."""

    def __init__(self, log):
        self.log = log

    def pages(self, sender, day):
        return 0 if day.day == 4 else 3

    def fetch(self, sender, day, page):
        open(f"{self.log}/{sender}_{day}_{page}", "w").close()
        for n in range(4):
            who = "bank" if n % 2 else "shop"
            if sender in (None, who):
                yield (f"{day}-{page}-{n}", who, datetime(day.year, day.month, day.day, 6 * n, page), None if n == 3 else "{}")


@pytest.fixture
def box(spark, tmp_path):
    return read_mailbox(spark, Folder(str(tmp_path)), FIRST, LAST), lambda: sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/*"))


def test_all_mails(box):
    mails, fetched = box
    got = mails.collect()
    assert len(got) == 19 * 3 * 4 and len({r.id for r in got}) == len(got) and sum(r.payload is None for r in got) == 19 * 3
    assert len(fetched()) == 19 * 3


def test_a_senders_day_asks_for_that_day_only(box):
    mails, fetched = box
    asked = mailbox(mails, "bank", "2025-03-07")
    assert sorted(r.id for r in asked.collect()) == sorted(f"2025-03-07-{p}-{n}" for p in range(3) for n in (1, 3))
    assert fetched() == [f"bank_2025-03-07_{p}" for p in range(3)]


def test_bounds_within_days_are_looked_at_by_the_hour(box):
    mails, fetched = box
    at = F.col("received")
    late = mails.where((at > datetime(2025, 3, 18, 12, 1)) & (at <= datetime(2025, 3, 19, 0, 1)))
    assert sorted(r.id for r in late.collect()) == ["2025-03-18-0-3", "2025-03-18-1-3", "2025-03-18-2-2", "2025-03-18-2-3", "2025-03-19-0-0", "2025-03-19-1-0"]
    assert {f.split("_")[1] for f in fetched()} == {"2025-03-18", "2025-03-19"}


def test_nothing_to_read(box):
    mails, fetched = box
    assert mails.where((F.col("received") > datetime(2026, 1, 1)) & (F.col("sender") == "bank")).count() == 0
    assert mails.where((F.col("received") >= datetime(2025, 3, 4)) & (F.col("received") < datetime(2025, 3, 5))).count() == 0
    assert fetched() == []
    assert mails.where((F.col("sender") == "bank") & (F.col("sender") == "shop")).count() == 0


def test_the_plan_shows_what_is_pushed(box):
    mails, _ = box
    plan = mailbox(mails, "bank", "2025-03-07")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan mailbox" in plan and "= bank" not in plan and "2025-03-08 00:00:00" in plan
