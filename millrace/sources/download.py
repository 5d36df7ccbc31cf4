"""Addresses of public dumps and their download into a shared folder.

What is on the network comes by a function ``fetch`` (address to bytes) that the
caller may replace; the default is plain HTTP. Listings are read on the driver,
since they are short; files are downloaded by tasks, a row each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import zlib
from collections.abc import Callable, Iterator
from datetime import date
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.core.session import prepare
from millrace.sinks.writers import place

Fetch = Callable[[str], bytes]
CRAWL, CRAWL_INDEX, DUMPS = "https://data.commoncrawl.org", "https://index.commoncrawl.org", "https://dumps.wikimedia.org"
#: Job of a dump whose files hold all articles.
ARTICLES = "articlesmultistreamdump"


def http(url: str, timeout: float = 60) -> bytes:
    """The body of a GET request; what isn't a success raises."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "millrace"}), timeout=timeout) as r:
        return r.read()


def crawl_listings(start: str, end: str, news: bool = False, fetch: Fetch = http, data: str = CRAWL, index: str = CRAWL_INDEX) -> list[str]:
    """Addresses of the path listings of all crawls between two ISO weeks ("2024-10"), newest first as published, or of news months.

    Only crawls that the published index names are given.
    """
    if news:
        (y, m), last = (tuple(map(int, s.split("-"))) for s in (start, end))
        if (y, m) > last:
            raise ValueError(f"{start} is after {end}")
        months = []
        while (y, m) <= min(last, (date.today().year, date.today().month)):
            months.append(f"{data}/crawl-data/CC-NEWS/{y}/{m:02d}/warc.paths.gz")
            y, m = (y + 1, 1) if m == 12 else (y, m + 1)
        return months
    monday = lambda s: date.fromisocalendar(*map(int, s.split("-")), 1)
    if monday(start) > monday(end):
        raise ValueError(f"{start} is after {end}")
    names = [x["id"] for x in json.loads(fetch(f"{index}/collinfo.json"))]
    weeks = [(n, m[1]) for n in names if (m := re.fullmatch(r"CC-MAIN-(\d{4}-\d{2})", n))]
    return [f"{data}/crawl-data/{n}/warc.paths.gz" for n, week in weeks if monday(start) <= monday(week) <= monday(end)]


def crawl_files(listings: list[str], fetch: Fetch = http, data: str = CRAWL, limit: int | None = None) -> list[str]:
    """Addresses of the archives that the listings (gzipped or plain lists of paths) name."""
    out = []
    for url in listings:
        raw = fetch(url)
        lines = (zlib.decompress(raw, zlib.MAX_WBITS | 32) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines()
        out += [urljoin(f"{data}/", line.strip()) for line in lines if line.strip()]
    return out[:limit]


def dump_files(language: str = "en", day: str | None = None, fetch: Fetch = http, root: str = DUMPS) -> list[str]:
    """Addresses of an encyclopedia's article files, of one day or of the newest finished dump."""
    base = f"{root}/{language}wiki"

    def status(d: str) -> dict:
        return json.loads(fetch(f"{base}/{d}/dumpstatus.json"))["jobs"][ARTICLES]

    if day is None:
        for d in sorted(set(re.findall(r">(\d{8})/?<", fetch(base).decode())), reverse=True):
            try:
                job = status(d)
            except (OSError, ValueError, KeyError):  # not there or not to be read: the next older one
                continue
            if job.get("status") == "done":
                day = d
                break
        else:
            raise ValueError(f"no finished dump at {base}")
    else:
        job = status(day)
    return [f"{base}/{day}/{name}" for name in job["files"] if "xml" in name]


def paper_files(listing: str) -> list[str]:
    """Tars of a bucket listing (date, time, size, name a line), in order of name."""
    return sorted(parts[3] for line in listing.splitlines() if len(parts := line.split()) >= 4 and ".tar" in parts[3])


def file_name(url: str) -> str:
    """A name for a downloaded file: its address without what a path may not hold, told apart by a digest."""
    tail = re.sub(r"[^A-Za-z0-9._-]+", "-", urlsplit(url).path.strip("/"))[-120:] or "file"
    return f"{hashlib.sha256(url.encode()).hexdigest()[:12]}-{tail}"


def download(urls: DataFrame, folder: str, fetch: Fetch = http, url_col: str = "url", retries: int = 3, wait: float = 1.0, per_task: int = 1) -> DataFrame:
    """(url, path, bytes, error) of each distinct address: files in a shared, mounted folder.

    What is there already is not fetched again, so a run that broke off goes on
    where it stood; a file gets its name when it is whole. An address that fails
    ``retries`` times has a null path and its error; null addresses go.
    """
    prepare(urls.sparkSession)
    todo = urls.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    tasks = max(1, -(-todo.count() // per_task))

    def one(url: str) -> tuple[str, str | None, int | None, str | None]:
        path, problem = f"{folder}/{file_name(url)}", ""
        if os.path.exists(path):
            return url, path, os.path.getsize(path), None
        for k in range(retries):
            try:
                body = fetch(url)
                place(path, lambda f: f.write(body))
                return url, path, len(body), None
            except Exception as e:  # whatever a source raises is that row's error
                problem = f"{type(e).__name__}: {e}"[:500]
                time.sleep(wait * 2**k if k + 1 < retries else 0)
        return url, None, None, problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url in b.column(0).to_pylist():
                got = one(url)
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(got, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["url", "path", "bytes", "error"])

    return todo.repartition(min(tasks, 10_000)).mapInArrow(run, "url string, path string, bytes long, error string")


def failed(rows: DataFrame, error_col: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that went well, without the error column, and rows that failed."""
    return rows.where(F.col(error_col).isNull()).drop(error_col), rows.where(F.col(error_col).isNotNull())
