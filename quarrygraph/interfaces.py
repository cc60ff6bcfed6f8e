"""What parts from outside must offer, and a registry of them by kind and name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.operators import embed, publish, semantic

#: Parts say for which version they were made; another one is refused.
VERSION = "1"


class Source(Protocol):
    def artifacts(self, spark: SparkSession, repo_id: str) -> DataFrame: ...


class Analyser(Protocol):
    def analyse(self, ref: str, module: str, test: bool, source: str) -> list[tuple[str, dict, list[dict]]]: ...


class Forge(Protocol):
    def merged_prs(self, spark: SparkSession, branch: str, since: Any) -> DataFrame: ...

    def commits(self, spark: SparkSession, branch: str, since: Any) -> DataFrame: ...


class Tracker(Protocol):
    def issues(self, spark: SparkSession, keys: list[str]) -> DataFrame: ...


Provider, Embedder = semantic.Provider, embed.Embedder


class Publisher(Protocol):
    def publish(self, folder: str, message: str) -> str | None: ...


KINDS: dict[str, type] = {"source": Source, "analyser": Analyser, "forge": Forge, "tracker": Tracker, "provider": Provider, "embedder": Embedder, "publisher": Publisher}
_PARTS: dict[tuple[str, str], Callable[..., Any]] = {}


def register(kind: str, name: str, factory: Callable[..., Any], version: str = VERSION) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}, one of {', '.join(KINDS)}")
    if version != VERSION:
        raise ValueError(f"{name} is made for version {version}, this is {VERSION}")
    _PARTS[kind, name] = factory


def make(kind: str, name: str, **options: Any) -> Any:
    if (kind, name) not in _PARTS:
        known = sorted(n for k, n in _PARTS if k == kind)
        raise LookupError(f"unknown {kind} {name!r}, one of {', '.join(known)}")
    return _PARTS[kind, name](**options)


def _builtin() -> None:
    from quarrygraph.operators import providers
    from quarrygraph.sources import forge

    register("forge", "rest", forge.RestForge)
    register("provider", "http", providers.HttpProvider)
    register("provider", "scripted", semantic.Scripted)
    register("embedder", "http", providers.HttpEmbedder)
    register("embedder", "hash", embed.HashEmbedder)
    register("publisher", "branch", publish.Branch)


_builtin()
