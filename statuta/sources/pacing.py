"""Calls to services, paced for each host by itself (R2)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def paced(rows: DataFrame, call: Callable[[tuple], tuple], schema: str, *, url: str = "url", delay: float = 1.0, in_flight: int = 1) -> DataFrame:
    """call(row) of each row, as rows of schema; rows hold an address in the column url.

    All rows of a host go to one task, where at most ``in_flight`` of its calls run at once, each followed by a pause of ``delay``; hosts do not wait for one
    another, be they in one task or in several. A host's rows are streamed through its task, not gathered.
    """
    names = [c for c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [f.split(" ")[0] for f in schema.split(", ")]

        def host_calls(own: list[tuple]) -> list[tuple]:
            found = []
            for row in own:
                found.append(call(row))
                time.sleep(delay)
            return found

        for batch in batches:
            lanes: dict[tuple[str, int], list[tuple]] = {}
            for i, (host, *row) in enumerate(batch[["_host", *names]].itertuples(index=False, name=None)):
                lanes.setdefault((host, i % in_flight), []).append(tuple(row))
            if lanes:
                with ThreadPoolExecutor(len(lanes)) as pool:
                    found = [x for part in pool.map(host_calls, lanes.values()) for x in part]
                yield pd.DataFrame(found, columns=out)

    dealt = rows.select(F.regexp_extract(F.lower(url), HOST, 1).alias("_host"), *names).repartition("_host")
    return dealt.mapInPandas(run, schema)
