"""Scans of sources page by page under a policy, over any fetch function; what fails becomes a row and stops nothing.

The library itself opens no connection: ``fetch`` is given by the caller, and runs in tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

SCANNED = "source string, page int, url string, status string, attempts int, detail string, html string, continuation string"


@dataclass(frozen=True)
class Page:
    """What a fetch returns."""

    body: str
    kind: str = "text/html"


@dataclass(frozen=True)
class Policy:
    """Bounds of a scan: pages of a source, attempts of a page and the wait before the next (doubled each time), size, kinds and hosts."""

    pages: int = 20
    attempts: int = 3
    wait: float = 0.25
    bytes: int = 12_000_000
    kinds: tuple[str, ...] = ("text/html", "application/xhtml+xml", "application/json")
    hosts: tuple[str, ...] = ()


def fetched(url: str, fetch: Callable[[str], Page], policy: Policy, sleep: Callable[[float], None] = time.sleep) -> tuple[Page | None, str, int, str]:
    """Page, status, attempts and what went wrong. A page of another kind or size is not asked for again."""
    host = (urlsplit(url).hostname or "").lower()
    if urlsplit(url).scheme not in ("http", "https") or (policy.hosts and host not in policy.hosts):
        return None, "refused", 0, "host or scheme not allowed"
    wrong = ""
    for attempt in range(1, policy.attempts + 1):
        try:
            page = fetch(url)
        except Exception as e:  # noqa: BLE001  whatever a source does wrong is a row of the result
            wrong = f"{type(e).__name__}: {e}"[:200]
            if attempt < policy.attempts:
                sleep(policy.wait * 2 ** (attempt - 1))
            continue
        if page.kind.split(";")[0].strip().lower() not in policy.kinds:
            return None, "wrong_kind", attempt, page.kind[:80]
        if len(page.body.encode("utf-8", "surrogatepass")) > policy.bytes:
            return None, "too_large", attempt, f"over {policy.bytes} bytes"
        return page, "ok", attempt, ""
    return None, "failed", policy.attempts, wrong


def walk(source: str, start: str, fetch: Callable[[str], Page], next_page: Callable[[str, str], str | None], policy: Policy, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Pages of one source from ``start``, following the next page it names; ends at its bound, at a page seen before, or at a failure.

    The last row's ``continuation`` is where the next scan goes on: the next page, or the one that failed; null at the end.
    """
    seen, url = set(), start
    for number in range(1, policy.pages + 1):
        seen.add(url)
        page, status, attempts, detail = fetched(url, fetch, policy, sleep)
        following = next_page(page.body, url) if page is not None else url if status == "failed" else None
        ends = page is None or following is None or following in seen or number == policy.pages
        yield {"source": source, "page": number, "url": url, "status": status, "attempts": attempts, "detail": detail, "html": page.body if page else None, "continuation": following if ends and (page is None or following not in seen) else None}
        if ends:
            return
        url = following


def scan(sources: DataFrame, fetch: Callable[[str], Page], next_page: Callable[[str, str], str | None], policy: Policy = Policy(), parallel: int | None = None) -> DataFrame:
    """All pages of ``sources`` (source, start; a null start is skipped), each source walked by one task, many at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCANNED.split(",")]
        for batch in batches:
            for source, start in zip(batch["source"], batch["start"]):
                if start:
                    yield pd.DataFrame(list(walk(source, start, fetch, next_page, policy)), columns=names).astype({"page": "Int32", "attempts": "Int32"})

    rows = sources.select("source", "start")
    return (rows.repartition(parallel, "source", "start") if parallel else rows).mapInPandas(run, SCANNED)


def resumed(sources: DataFrame, done: DataFrame) -> DataFrame:
    """``sources`` starting where their last scan left off, if it did; others start anew."""
    left = done.filter("continuation IS NOT NULL").select("source", "continuation")
    return sources.join(left, "source", "left").selectExpr("source", "coalesce(continuation, start) AS start")
