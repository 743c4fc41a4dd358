"""One place where a query, its SQL twin and the inventory lines it covers meet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Runner
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(name: str, covers: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, run, tuple(covers.split()), sql)
        return run

    return add
