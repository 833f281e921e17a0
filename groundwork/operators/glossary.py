"""Glossary terms in texts, found by one automaton over all surfaces."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import glossary_hits

#: A glossary of at most so many bytes of surfaces and terms goes to every task.
MOST_BYTES = 64 << 20


class Finder:
    """Surfaces in their order (longest first), each with its term."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        self.entries = entries
        self.all = self._automaton(range(len(entries)))
        # A blanked span can make a surface that has a space where the text had none.
        self.spaced = self._automaton(k for k, (surface, _) in enumerate(entries) if " " in surface)

    def _automaton(self, places: Iterable[int]) -> ahocorasick.Automaton | None:
        made = ahocorasick.Automaton()
        for k in places:
            made.add_word(self.entries[k][0], k)
        made.make_automaton()
        return made if len(made) else None

    def hits(self, text: str) -> list[str]:
        seen = set() if self.all is None else {k for _, k in self.all.iter(text)}
        waiting, found, rest = sorted(seen), {}, text
        while waiting:
            at = heapq.heappop(waiting)
            surface, term = self.entries[at]
            shorter = rest.replace(surface, " ")
            if shorter == rest:
                continue
            rest = shorter
            found.setdefault(term)
            if self.spaced is not None:
                for _, k in self.spaced.iter(rest):
                    if k > at and k not in seen:
                        seen.add(k)
                        heapq.heappush(waiting, k)
        return list(found)


def with_hits(rows: DataFrame, text: str, surfaces: DataFrame, out: str = "hits") -> DataFrame:
    """rows and `out`: the terms whose surfaces stand in the text, longest first, each once; as `functions.text.glossary_hits`.

    surfaces: the one row of `functions.text.surfaces`. Its size is looked up first: up to
    MOST_BYTES it is sent to the tasks, each of which makes one automaton and runs over a text
    once, whatever the number of surfaces; beyond, each text is folded over the array, where it is.
    A null or empty text, or a glossary without surfaces, has no hits (an empty array).
    """
    sizes = F.transform("surfaces", lambda x: (F.octet_length(x["surface"]) + F.octet_length(x["ko"])).cast("long"))
    if (surfaces.select(F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)).first() or [0])[0] > MOST_BYTES:
        name = "surfaces"
        while name in (*rows.columns, out):
            name += "_"
        return rows.withColumn(name, surfaces.select("surfaces").scalar()).withColumn(out, glossary_hits(F.col(text), F.col(name))).drop(name)
    row = surfaces.first()
    sent = rows.sparkSession.sparkContext.broadcast([tuple(x) for x in (row["surfaces"] if row else None) or ()])

    @F.pandas_udf("array<string>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(sent.value)
        for series in texts:
            yield series.map(lambda t: finder.hits(t) if isinstance(t, str) else [])

    return rows.withColumn(out, found(F.lower(text)))
