"""Sources by type: readers register a name, a configuration lists instances."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from procura.sources import catalog, notices

log = logging.getLogger(__name__)
READERS: dict[str, Callable[..., DataFrame]] = {
    "list": notices.read_list,
    "api": notices.read_api,
    "feed": notices.read_feed,
    "catalog": lambda spark, path, name="catalog", **o: catalog.quotes(catalog.load_rows(spark, path), name, **o),
}


def register_source(kind: str):
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        READERS[kind] = f
        return f

    return keep


@dataclass(frozen=True)
class Source:
    name: str
    kind: str
    path: str
    priority: int = 50
    enabled: bool = True
    options: dict = field(default_factory=dict)


def build(spark: SparkSession, sources: list[Source], only: tuple[str, ...] = ()) -> list[tuple[Source, DataFrame]]:
    """Readable sources by priority; ``only`` names sources whether enabled or not; unknown and broken ones are logged."""
    out = []
    for s in sorted(sources, key=lambda s: (s.priority, s.name)):
        if s.name not in only if only else not s.enabled:
            continue
        if s.kind not in READERS:
            log.warning("unknown kind of source: %s", s.kind)
            continue
        try:
            rows = READERS[s.kind](spark, s.path, name=s.name, **s.options)
            rows.isEmpty()  # readers are lazy: a path or file that cannot be read shows here, not in the union of all
            out.append((s, rows))
        except Exception as e:  # noqa: BLE001  one source does not stop the others
            log.warning("source %s failed: %s", s.name, e)
    return out
