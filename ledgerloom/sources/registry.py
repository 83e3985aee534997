"""Known sources by alias, kept in memory."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from ledgerloom.sources.readers import SourceError, kind_of


@dataclass(frozen=True)
class Source:
    alias: str
    uri: str
    kind: str
    status: str = "connected"


@dataclass
class Registry:
    _sources: dict[str, tuple[int, Source]] = field(default_factory=dict)
    _turn: count = field(default_factory=count)

    def upsert(self, alias: str, uri: str, kind: str | None = None) -> Source:
        if not alias.strip() or not uri.strip():
            raise SourceError("a source needs an alias and a URI")
        source = Source(alias, uri, kind or kind_of(uri))
        self._sources[alias] = next(self._turn), source
        return source

    def list(self) -> list[Source]:
        """Newest first."""
        return [s for _, s in sorted(self._sources.values(), key=lambda x: -x[0])]

    def resolve(self, alias_or_uri: str) -> str:
        """A URI as it is; an alias's URI."""
        if "://" in alias_or_uri:
            return alias_or_uri
        if alias_or_uri not in self._sources:
            raise SourceError(f"unknown source {alias_or_uri!r}")
        return self._sources[alias_or_uri][1].uri
