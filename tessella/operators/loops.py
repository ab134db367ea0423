"""What a driver does around passes: choosing terms, filling gaps until they are closed, stopping, marking how far it came."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def fresh_terms(terms: DataFrame, done: DataFrame, order: Column, most: int) -> DataFrame:
    """term, slug of ``most`` clean terms in the order of a hash whose slug is not ``done`` (slug); of equal slugs the first."""
    rows = terms.select("term").where(T.is_clean(F.col("term"))).withColumn("slug", T.slug(F.col("term")))
    first = rows.join(done.select("slug"), "slug", "left_anti").withColumn("__order", order).groupBy("slug").agg(F.min(F.struct("__order", "term")).alias("x"))
    return first.orderBy("x.__order", "x.term").limit(most).select(F.col("x.term").alias("term"), "slug")


def worklist(gap: DataFrame, key: str, order: str = "lastmod", most: int | None = None, seed: str = "0") -> DataFrame:
    """What is missing in the order in which it is fetched: the latest first ('lastmod', unknown last), by ``key`` ('id'), or by a hash
    with a seed ('random')."""
    orders = {"lastmod": [F.desc_nulls_last("lastmod"), F.desc(key)], "id": [F.desc(key)], "random": [F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.col(key)]}
    if order not in orders:
        raise ValueError(f"no order {order!r}")
    rows = gap.orderBy(*orders[order])
    return rows if most is None else rows.limit(most)


def owed(rows: DataFrame, version: Column, wanted: str, key: str, shard: int | None = None, shards: int = 1) -> DataFrame:
    """Rows whose model version is another than ``wanted``, or none; of one shard of several by the key's remainder."""
    if shard is not None and not 0 <= shard < shards:
        raise ValueError(f"no shard {shard} of {shards}")
    rows = rows.where(~version.eqNullSafe(F.lit(wanted)))
    return rows if shard is None else rows.where(F.pmod(F.col(key), F.lit(shards)) == shard)


def drain(step: Callable[[], int], most: int = 60) -> list[int]:
    """Calls ``step``, which does a batch and tells its size, until a batch is empty, ``most`` times at most; the sizes."""
    sizes = []
    while len(sizes) < most and (n := step()):
        sizes.append(n)
    return sizes


@dataclass
class Stop:
    """When to end a loop: the coverage (percent) is reached, a batch brings fewer rows a term than the floor, or several batches in a row
    bring none."""

    target: float | None = None
    floor: float | None = None
    empty: int | None = None
    _none: int = 0

    def reason(self, coverage: float, new: int, terms: int = 1) -> str | None:
        self._none = self._none + 1 if new == 0 else 0
        if self.target is not None and coverage >= self.target:
            return "coverage"
        if self.floor is not None and new // max(1, terms) < self.floor:
            return "novelty"
        if self.empty is not None and self._none >= self.empty:
            return "empty"
        return None


def head(pages: Callable[[int], list[tuple[str, str]]], marker: str | None, most: int = 100) -> tuple[list[tuple[str, str]], str | None]:
    """Items (id, cursor) from the newest down to the marker, and the new marker.

    ``pages(k)`` gives a page, the newest first. The marker moves to the newest cursor only if the walk came down to the old
    one; without one, a single page is taken.
    """
    items: list[tuple[str, str]] = []
    for k in range(1 if marker is None else most):
        page = pages(k)
        items += [x for x in page if marker is None or x[1] > marker]
        if marker is None or not page or any(cursor <= marker for _, cursor in page):
            return items, max((c for _, c in items), default=marker)
    return items, marker


def fetch_pages(terms: list[str], fetch: Callable[[str, int], list], most: int, done: set[tuple[str, int]]) -> dict[tuple[str, int], list]:
    """Pages of each term that are not ``done``; an empty page ends its term. What was fetched is added to ``done``."""
    out: dict[tuple[str, int], list] = {}
    for term in terms:
        for page in range(1, most + 1):
            if (term, page) not in done:
                out[term, page] = fetch(term, page)
                done.add((term, page))
                if not out[term, page]:
                    break
    return out


@dataclass
class Recent:
    """Values by key for a time, a bounded number of them: the oldest goes first."""

    make: Callable[[str], object]
    seconds: float = 600.0
    most: int = 512
    clock: Callable[[], float] = time.monotonic
    held: dict[str, tuple[float, object]] = field(default_factory=dict)

    def get(self, key: str) -> object:
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        value = self.make(key)
        self.held.pop(key, None)
        if len(self.held) >= self.most:
            del self.held[min(self.held, key=lambda k: self.held[k][0])]
        self.held[key] = (now, value)
        return value

    def reset(self) -> None:
        self.held.clear()


def in_order(steps: dict[str, tuple[list[str], Callable[[], object]]]) -> dict[str, object]:
    """Runs named steps, each after those that it needs, one at a time; a step that fails ends the run. A circle is an error."""
    out: dict[str, object] = {}
    while len(out) < len(steps):
        ready = [name for name, (needs, _) in steps.items() if name not in out and all(n in out for n in needs)]
        if not ready:
            raise ValueError(f"steps need each other or what is not there: {sorted(set(steps) - set(out))}")
        out[ready[0]] = steps[ready[0]][1]()
    return out
