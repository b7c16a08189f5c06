"""A token-paginated connector as a Spark data source, its transport injected."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


class RateLimited(Exception):
    """To be tried again later."""


class PermanentError(Exception):
    """Not to be tried again."""


def pages(request: Callable[[object], dict], first=None, items: str = "items", token: str = "next", most: int = 10_000, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """The items of all pages. A token that comes again, and a page of another shape, are errors."""
    seen, at = set(), first
    for _ in range(most):
        for n in range(retries + 1):
            try:
                page = request(at)
                break
            except PermanentError:
                raise
            except (RateLimited, OSError):
                if n == retries:
                    raise
                sleep(min(30.0, 0.25 * 2**n))
        if not isinstance(page, dict) or not isinstance(page.get(items), list):
            raise PermanentError("a page without its list of items")
        yield from page[items]
        at = page.get(token)
        if not at:
            return
        if at in seen:
            raise PermanentError("a page token came twice")
        seen.add(at)
    raise PermanentError("too many pages")


def read(spark: SparkSession, request: Callable[[object], dict], **options) -> DataFrame:
    """One row of JSON text per item. Pages follow one another, so one task fetches them; rows are dealt out after."""

    def run(frames):
        import pandas as pd

        for _ in frames:
            rows = []
            for item in pages(request, **options):
                rows.append(json.dumps(item, sort_keys=True))
                if len(rows) == 1000:
                    yield pd.DataFrame({"original_record": rows})
                    rows = []
            if rows:
                yield pd.DataFrame({"original_record": rows})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "original_record string")
