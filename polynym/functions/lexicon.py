"""Readings of words: which words a text is made of, by least cost."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: Cost of a character that no word covers; a word costs 1 unless the lexicon says otherwise.
UNKNOWN = 4.0
#: Entries that a lexicon may have at most: it is held by every worker.
MOST = 2_000_000


class Lexicon:
    """Words with readings and costs, as a trie."""

    def __init__(self, entries: dict[str, tuple[str, float]]):
        self.trie: dict = {}
        for word, value in entries.items():
            at = self.trie
            for c in word:
                at = at.setdefault(c, {})
            if word:
                at[""] = value

    def __bool__(self) -> bool:
        return bool(self.trie)

    def segments(self, text: str) -> list[tuple[str, str | None]]:
        """(part, reading) along the path of least cost; unknown characters are parts of their own, without reading. Among equals longer first words win."""
        n = len(text)
        cost, take = [0.0] * (n + 1), [(1, None)] * n
        for i in range(n - 1, -1, -1):
            cost[i] = UNKNOWN + cost[i + 1]
            at = self.trie
            for j in range(i, n):
                at = at.get(text[j])
                if at is None:
                    break
                if "" in at:
                    reading, own = at[""]
                    if own + cost[j + 1] <= cost[i]:
                        cost[i], take[i] = own + cost[j + 1], (j + 1 - i, reading)
        out, i = [], 0
        while i < n:
            size, reading = take[i]
            out.append((text[i : i + size], reading))
            i += size
        return out


@dataclass(frozen=True)
class LexiconSource:
    """Entries (word, reading, cost) by language, which make a ``Lexicon`` where they are needed."""

    entries: dict[str, dict[str, tuple[str, float]]] = field(hash=False)

    def of(self, lang: str, base: dict[str, str]) -> Lexicon:
        return Lexicon({w: (r, 1.0) for w, r in base.items()} | self.entries.get(lang, {}))


Words = "dict[str, str] | LexiconSource | None"


def as_lexicon(words: Words, lang: str, base: dict[str, str] | None = None) -> Lexicon:
    """A plain dict holds Japanese words, each at a cost of 1."""
    if isinstance(words, LexiconSource):
        return words.of(lang, base or {})
    return LexiconSource({"ja": {w: (r, 1.0) for w, r in (words or {}).items()}}).of(lang, base or {})


def read_lexicon(spark: SparkSession, path: str) -> LexiconSource:
    """Tab-separated ``lang, word, reading, cost`` (empty: 1), from any path that Spark reads.

    Lexicons are held by the driver and every worker; more than ``MOST`` entries
    are refused. Of entries that repeat a word the least cost wins, then the first reading in order.
    """
    rows = spark.read.schema("lang string, word string, reading string, cost double").option("sep", "\t").option("quote", "").csv(path).where("word <> '' and reading is not null")
    if (n := rows.count()) > MOST:
        raise ValueError(f"{n} entries are more than {MOST}")
    out: dict[str, dict[str, tuple[str, float]]] = {}
    for r in rows.collect():
        mine, new = out.setdefault(r.lang, {}), (r.reading, 1.0 if r.cost is None else r.cost)
        mine[r.word] = min(mine.get(r.word, new), new, key=lambda e: (e[1], e[0]))
    return LexiconSource(out)
