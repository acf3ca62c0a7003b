"""Title pairs of a knowledge base as a Spark data source: ``spark.read.format("sitelinks")``.

    spark.dataSource.register(SitelinkSource)
    spark.read.format("sitelinks").options(l1="en", l2="ru", per_type=1000).load().where("bucket = 'city'")

Options: ``l1``, ``l2``; ``per_type``, rows of each bucket at most; ``page``, rows of a
request; ``partitions``; ``rate``, requests a second of the whole read; ``url`` of the
endpoint; ``transport``, as ``module:function``, if requests go by other ways than HTTP.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from polynym.sources.remote import PAGE, QUERY_URL, RATE, Client, http, sitelink_query
from polynym.sources.schema import TYPE_BUCKETS

SCHEMA = "ord int, rn int, qid string, l1_title string, l2_title string, wikidata_type string, type_label string, bucket string"


@dataclass
class Pages(InputPartition):
    """What one partition asks for: (bucket's place, offset, rows)."""

    number: int
    of: int
    start: float
    wanted: tuple[tuple[int, int, int], ...]


def tail(uri: str) -> str:
    return uri.rsplit("/", 1)[-1]


class SitelinkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        missing = [o for o in ("l1", "l2") if not options.get(o)]
        if missing:
            raise ValueError(f"the source needs the option {missing[0]}")
        self.l1, self.l2 = options["l1"], options["l2"]
        self.per_type, self.page = int(options.get("per_type", 1000)), int(options.get("page", PAGE))
        self.parts, self.rate = int(options.get("partitions", 4)), float(options.get("rate", RATE))
        self.url, self.transport = options.get("url", QUERY_URL), options.get("transport")
        self.buckets = {b for _, b in TYPE_BUCKETS}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on the bucket tell which requests are made at all; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("bucket",):
                self.buckets &= {f.value}
            elif isinstance(f, In) and f.attribute == ("bucket",):
                self.buckets &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[Pages]:
        """Pages are dealt out by turns, those of a bucket's later offsets after all first ones."""
        wanted = [(i, offset, min(self.page, self.per_type - offset)) for offset in range(0, self.per_type, self.page) for i, (_, b) in enumerate(TYPE_BUCKETS) if b in self.buckets]
        of, start = max(1, min(self.parts, len(wanted))), time.time()
        return [Pages(k, of, start, tuple(wanted[k::of])) for k in range(of)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        send = http
        if self.transport:
            module, _, name = self.transport.partition(":")
            send = getattr(importlib.import_module(module), name)
        client = Client(send, self.rate, query_url=self.url).planned(partition.start, partition.number, partition.of)
        ended: set[int] = set()
        for i, offset, n in partition.wanted:
            if i in ended:
                continue
            type_id, bucket = TYPE_BUCKETS[i]
            rows = client.query(sitelink_query(self.l1, self.l2, type_id, n, offset))
            if len(rows) < n:
                ended.add(i)
            for k, r in enumerate(rows[:n]):
                yield i, offset + k, tail(r.get("entity") or ""), r.get("l1Title") or "", r.get("l2Title") or "", tail(r.get("type") or ""), r.get("typeLabel") or "", bucket


class SitelinkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sitelinks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SitelinkReader:
        return SitelinkReader(self.options)
