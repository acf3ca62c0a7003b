"""A knowledge base's query and label endpoints as Spark sources.

Endpoints cap the request rate for a client as a whole. So the moments at which
requests may be sent are planned for a read, ``rate`` of them a second, and dealt
out to its partitions by turns (``Slots``); pages are fetched on executors.
``datasource`` has the same reads for ``spark.read.format``. The transport is any picklable callable, which tests
replace: ``transport(url, params) -> (status, body)``.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polynym.functions.text import id_from_uri
from polynym.sources.schema import TYPE_BUCKETS

# The public endpoints, the languages asked for by default and the documented rate.
QUERY_URL = "https://query.wikidata.org/sparql"
LABEL_URL = "https://www.wikidata.org/w/api.php"
LANGUAGES = ("en", "ru", "zh", "ar", "de", "fr")
RATE = 5.0
PAGE = 1000

Transport = Callable[[str, dict[str, str]], tuple[int, str]]


def http(url: str, params: dict[str, str], timeout: float = 60) -> tuple[int, str]:
    request = urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}", headers={"Accept": "application/sparql-results+json", "User-Agent": "polynym"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


@dataclass
class Slots:
    """Moments for requests: slot j is ``j / rate`` seconds after ``start`` and belongs to partition ``j % of``.

    No two partitions share a slot, so a read keeps to the rate however many of
    them run at once. Clocks of executors have to agree to a fraction of a slot.
    """

    start: float
    number: int = 0
    of: int = 1
    rate: float = RATE
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.time
    _last: int = field(init=False, default=-1)

    def wait(self) -> None:
        first = max(self._last + 1, math.ceil((self.clock() - self.start) * self.rate))
        self._last = first + (self.number - first) % self.of
        while (left := self.start + self._last / self.rate - self.clock()) > 0:
            self.sleep(left)


@dataclass
class Client:
    """Rate-limited requests; queries are tried again with growing pauses. ``slots``: of a read with several partitions."""

    transport: Transport = http
    rate: float = RATE
    tries: int = 5
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    query_url: str = QUERY_URL
    label_url: str = LABEL_URL
    slots: Slots | None = None
    _tokens: float = field(init=False, default=-1.0)
    _then: float = field(init=False, default=0.0)

    def planned(self, start: float, number: int, of: int) -> Client:
        """The client of one partition of a read."""
        return replace(self, slots=Slots(start, number, of, self.rate))

    def _wait(self) -> None:
        if self.slots is not None:
            return self.slots.wait()
        while True:
            now = self.clock()
            self._tokens = self.rate if self._tokens < 0 else min(self.rate, self._tokens + (now - self._then) * self.rate)
            self._then = now
            if self._tokens >= 1:
                self._tokens -= 1
                return
            self.sleep(max((1 - self._tokens) / self.rate, 0.01))

    def query(self, text: str) -> list[dict[str, str]]:
        """Rows of a query, each a value for every bound variable."""
        cause: Exception | None = None
        for n in range(self.tries):
            self._wait()
            try:
                status, body = self.transport(self.query_url, {"query": text, "format": "json"})
                if status == 200:
                    return [{k: v.get("value") for k, v in row.items()} for row in json.loads(body)["results"]["bindings"]]
                cause = None if status in (429, 503) else ValueError(f"status {status}")
            except (OSError, ValueError, KeyError) as e:
                cause = e
            self.sleep(2**n)
        raise RuntimeError(f"the query failed {self.tries} times") from cause

    def pages(self, make: Callable[[int], str], target: int, page: int = PAGE) -> Iterator[dict[str, str]]:
        """Up to ``target`` rows; a short or empty page is the last."""
        done = 0
        while done < target:
            rows = self.query(make(done))
            yield from rows[: target - done]
            done += len(rows)
            if len(rows) < page:
                return

    def labels(self, ids: list[str], languages: list[str]) -> list[tuple[str, str, str]]:
        if not ids:
            return []
        self._wait()
        status, body = self.transport(self.label_url, {"action": "wbgetentities", "ids": "|".join(ids), "props": "labels", "languages": "|".join(languages), "format": "json"})
        if status != 200:
            raise RuntimeError(f"status {status}")
        return [(q, lang, info["value"]) for q, e in json.loads(body).get("entities", {}).items() for lang, info in e.get("labels", {}).items()]


def sitelink_query(l1: str, l2: str, type_id: str, limit: int = PAGE, offset: int = 0) -> str:
    """Entities of a type that have an article in both languages, with the titles and the type's English label."""
    article = "?{0} schema:about ?entity ; schema:isPartOf <https://{1}.wikipedia.org/> ; schema:name ?{2} ."
    lines = [
        "SELECT ?entity ?l1Title ?l2Title ?type ?typeLabel WHERE {",
        article.format("l1Article", l1, "l1Title"),
        article.format("l2Article", l2, "l2Title"),
        f"?entity wdt:P31 wd:{type_id} . BIND(wd:{type_id} AS ?type)",
        'SERVICE wikibase:label { bd:serviceParam wikibase:language "en" . ?type rdfs:label ?typeLabel . }',
        f"}} LIMIT {limit} OFFSET {offset}",
    ]
    return "\n".join(lines)


def read_query(spark: SparkSession, query: str, columns: list[str], client: Client | None = None) -> DataFrame:
    """The rows of any query, as string columns."""
    client = client or Client()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield pd.DataFrame([[r.get(c) for c in columns] for r in client.query(query)], columns=columns, dtype=object)

    return spark.range(1, numPartitions=1).mapInPandas(fetch, ", ".join(f"`{c}` string" for c in columns))


def read_sitelinks(spark: SparkSession, l1: str, l2: str, per_type: int = 1000, client: Client | None = None, buckets: tuple[tuple[str, str], ...] = TYPE_BUCKETS, partitions: int = 1) -> DataFrame:
    """Title pairs of each type bucket, at most ``per_type`` each, with ``ord`` and ``rn`` for their order."""
    client, start = client or Client(), time.time()
    names = ["entity", "l1Title", "l2Title", "type", "typeLabel"]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = client if partitions == 1 else client.planned(start, TaskContext.get().partitionId(), partitions)
        for batch in batches:
            for i in batch["id"].tolist():
                q, bucket = buckets[i]
                rows = mine.pages(lambda offset, q=q: sitelink_query(l1, l2, q, min(per_type, PAGE), offset), per_type)
                yield pd.DataFrame([[i, n, bucket, *(r.get(c) or "" for c in names)] for n, r in enumerate(rows)], columns=["ord", "rn", "bucket", *names])

    rows = spark.range(0, len(buckets), numPartitions=partitions).mapInPandas(fetch, "ord int, rn int, bucket string, " + ", ".join(f"{c} string" for c in names))
    return rows.select("ord", "rn", id_from_uri(F.col("entity")).alias("qid"), F.col("l1Title").alias("l1_title"), F.col("l2Title").alias("l2_title"), id_from_uri(F.col("type")).alias("wikidata_type"), F.col("typeLabel").alias("type_label"), "bucket")


def read_labels(ids: DataFrame, languages: tuple[str, ...] = LANGUAGES, client: Client | None = None, at_once: int = 50) -> DataFrame:
    """``(qid, lang, label)`` for a table of ``qid``."""
    client = client or Client()

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["qid"].dropna().tolist()
            for k in range(0, len(known), at_once):
                yield pd.DataFrame(client.labels(known[k : k + at_once], list(languages)), columns=["qid", "lang", "label"])

    return ids.select("qid").distinct().mapInPandas(fetch, "qid string, lang string, label string")
