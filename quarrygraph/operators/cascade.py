"""Match-or-mint: candidates of feature, business rule and risk entities find their identity or get a new one.

Candidates of one repository and type are taken in the order of their content hash, because each may match what an earlier one
minted; groups of (repository, type) are independent. Targets are found by indices on external key, file, and component with a token
of the name. The indices list classes of targets that score alike (equal anchors, equal tokens), each with its slugs in a heap, so a
candidate meets every class that may count once, however many targets it has.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable

T_ANCHOR, T_NAME = 0.5, 0.8
_ANCHORS = "array<struct<file_path:string,symbol_path:string>>"
OUTPUT = f"repo_id string, entity_type string, slug string, name string, payload string, content_hash string, anchors {_ANCHORS}, rule string, signals map<string,double>, sources array<string>, conflict array<string>, warning string"


def _slugify(text: str) -> str:
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-") or "unnamed"


def _tokens(text: str) -> frozenset[str]:
    return frozenset(t for t in re.split("[^a-z0-9]+", text.lower()) if t)


def _hash(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(slots=True)
class _Known:
    slug: str
    name: str
    payload: dict
    anchors: frozenset
    touched: bool = False
    rule: str = ""
    signals: dict = field(default_factory=dict)
    sources: list = field(default_factory=list)
    conflict: list = field(default_factory=list)
    hash: str | None = None

    @property
    def symbols(self) -> frozenset:
        return frozenset(a for a in self.anchors if a[1])

    @property
    def files(self) -> frozenset:
        return frozenset(a[0] for a in self.anchors)

    @property
    def components(self) -> list[str]:
        return self.payload.get("related_components") or []

    @property
    def payload_hash(self) -> str:
        if self.hash is None:
            self.hash = _hash(self.payload)
        return self.hash


class _Turned(str):
    """A slug that a heap takes in descending order."""

    __slots__ = ()

    def __lt__(self, other):
        return str.__gt__(self, other)


class _Class:
    """Slugs of one class: a set, and a heap from which slugs that have left are dropped when they come up."""

    __slots__ = ("slugs", "heap", "order")

    def __init__(self, largest: bool):
        self.slugs, self.heap, self.order = set(), [], _Turned if largest else str

    def add(self, slug: str) -> None:
        self.slugs.add(slug)
        heapq.heappush(self.heap, self.order(slug))

    def first(self) -> str:
        while self.heap[0] not in self.slugs:
            heapq.heappop(self.heap)
        if len(self.heap) > 2 * len(self.slugs) + 16:
            self.heap = [self.order(s) for s in self.slugs]
            heapq.heapify(self.heap)
        return str(self.heap[0])


class Resolver:
    """The state of one repository and type while its candidates are taken one by one."""

    def __init__(self, entity_type: str, known: list[_Known], t_anchor: float = T_ANCHOR, t_name: float = T_NAME, largest_wins: bool = True):
        self.entity_type, self.t_anchor, self.t_name, self.largest_wins = entity_type, t_anchor, t_name, largest_wins
        self.known, self.numbers = {}, {}
        self.by_key = defaultdict(lambda: _Class(False))
        self.by_anchors, self.by_file = {}, defaultdict(set)  # classes of equal anchors, and those of a file
        self.by_words, self.by_word = {}, defaultdict(set)  # classes of equal tokens in a component, and those of a token there
        for k in known:
            self._index(k)

    def _places(self, k: _Known):
        """The classes of an entity: (index, key, postings, their keys)."""
        if k.files:
            yield self.by_anchors, k.anchors, self.by_file, k.files
        words = _tokens(k.name or "")
        for c in set(k.components) if words else ():
            yield self.by_words, (c, words), self.by_word, [(c, w) for w in words]

    def _index(self, k: _Known) -> None:
        self.known[k.slug] = k
        if k.payload.get("external_key"):
            self.by_key[k.payload["external_key"]].add(k.slug)
        for classes, key, postings, spots in self._places(k):
            if key not in classes:
                classes[key] = _Class(self.largest_wins)
                for spot in spots:
                    postings[spot].add(key)
            classes[key].add(k.slug)

    def _unindex(self, k: _Known) -> None:
        if key := k.payload.get("external_key"):
            self.by_key[key].slugs.discard(k.slug)
        for classes, key, postings, spots in self._places(k):
            classes[key].slugs.discard(k.slug)
            if not classes[key].slugs:
                del classes[key]
                for spot in spots:
                    postings[spot].discard(key)

    def _best(self, scored: list[tuple[float, str]]) -> tuple[float, str]:
        return max(scored) if self.largest_wins else min(scored, key=lambda s: (-s[0], s[1]))

    def _alike(self, component: str, words: frozenset):
        """Token sets of a component that may be similar enough: those that hold one of so many words that none could miss all of them."""
        spare = len(words) - math.ceil(self.t_name * len(words) - 1e-9) + 1
        if spare > len(words):
            return [w for c, w in self.by_words if c == component]
        rare = sorted((self.by_word.get((component, w), ()) for w in words), key=len)[:spare]
        return {w for _, w in set().union(*rare)}

    def take(self, name: str, payload: dict, anchors: frozenset, source: str) -> None:
        key = payload.get("external_key")
        hits = self.by_key.get(key) if key else None
        if hits and hits.slugs:
            return self._absorb(hits.first(), name, payload, anchors, source, "external_key", {})
        mine = _Known("", name, payload, anchors)
        symbols, files = mine.symbols, mine.files
        scored = []
        for spots in set().union(*(self.by_file.get(f, ()) for f in files)):
            theirs = frozenset(a for a in spots if a[1]) if symbols else None
            a, b = (symbols, theirs) if theirs else (files, {s[0] for s in spots})
            if (score := len(a & b) / len(a)) >= self.t_anchor:
                scored.append((score, self.by_anchors[spots].first()))
        if scored:
            score, slug = self._best(scored)
            return self._absorb(slug, name, payload, anchors, source, "anchor_overlap", {"anchor_overlap": round(score, 4)})
        words = _tokens(name)
        for c in set(mine.components) if words else ():
            for other in self._alike(c, words):
                if (score := len(words & other) / len(words | other)) >= self.t_name:
                    scored.append((score, self.by_words[c, other].first()))
        if scored:
            score, slug = self._best(scored)
            return self._absorb(slug, name, payload, anchors, source, "name_similarity", {"name_similarity": round(score, 4)})
        base = slug = f"{self.entity_type.replace('_', '-')}/{_slugify(name)}"
        n = self.numbers.get(base, 1)  # no slug is given back, so lower numbers stay taken
        while slug in self.known:
            n += 1
            slug = f"{base}-{n}"
            self.numbers[base] = n
        self._index(_Known(slug, name, payload, anchors, True, "minted", {}, [source]))
        return None

    def _absorb(self, slug: str, name: str, payload: dict, anchors: frozenset, source: str, rule: str, signals: dict) -> None:
        k = self.known[slug]
        self._unindex(k)
        if not k.touched:
            k.name, k.payload, k.anchors, k.sources, k.hash = name, payload, anchors, [], None
        else:
            a, b = k.payload.get("statement"), payload.get("statement")
            if a and b and a != b:
                k.conflict = sorted({*k.conflict, a, b})
            if len(anchors) > len(k.anchors):
                k.payload, k.hash = payload, None
            elif len(anchors) == len(k.anchors) and (new := _hash(payload)) > k.payload_hash:
                k.payload, k.hash = payload, new
            k.name, k.anchors = k.payload.get("name", k.name), k.anchors | anchors
        k.touched, k.rule, k.signals = True, rule, signals
        k.sources.append(source)
        self._index(k)


def _spots(anchors) -> frozenset:
    return frozenset((a["file_path"], a["symbol_path"]) for a in anchors) if anchors is not None else frozenset()


_LEFT = ["repo_id", "entity_type", "title", "payload", "content_hash", "anchors"]
_RIGHT = ["repo_id", "entity_type", "slug", "title", "payload", "anchors"]


def _resolve(largest_wins: bool):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        repo, entity_type = key
        # By place: the optimizer may give columns the names they had further up.
        left, right = left.set_axis(_LEFT, axis=1), right.set_axis(_RIGHT, axis=1)
        known = [_Known(r.slug, r.title, json.loads(r.payload or "{}"), _spots(r.anchors)) for r in right.itertuples()]
        state = Resolver(entity_type, known, largest_wins=largest_wins)
        out = []
        for r in left.sort_values(["content_hash", "payload"]).itertuples():
            anchors = _spots(r.anchors)
            if not anchors:
                out.append((repo, entity_type, None, r.title, r.payload, None, [], "rejected", {}, [r.content_hash], [], f"rejected {entity_type} '{r.title}': missing anchors"))
                continue
            state.take(r.title, json.loads(r.payload or "{}"), anchors, r.content_hash)
        for k in sorted((k for k in state.known.values() if k.touched), key=lambda k: k.slug):
            spots = [{"file_path": a, "symbol_path": b} for a, b in sorted(k.anchors, key=lambda a: (a[0], a[1] or ""))]
            payload = json.dumps(k.payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out.append((repo, entity_type, k.slug, k.name, payload, _hash(k.payload), spots, k.rule, k.signals, k.sources, k.conflict, None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in re.split(r", (?=\w+ \w)", OUTPUT)])

    return run


def match_or_mint(candidates: DataFrame, current: DataFrame, largest_wins: bool = True) -> DataFrame:
    """Resolved entities, and rejected candidates with a warning and no slug.

    candidates(repo_id, entity_type, name, payload, content_hash, anchors); current has slug besides. Anchors of current entities are
    mapped by renames before.
    """
    plain = lambda df: df.withColumn("anchors", F.transform("anchors", lambda a: F.struct(a["file_path"].alias("file_path"), a["symbol_path"].alias("symbol_path"))))
    left = plain(candidates.select("repo_id", "entity_type", "name", "payload", "content_hash", "anchors")).groupBy("repo_id", "entity_type")
    # Written first: two sides of one lineage share columns, which the optimizer then prunes on one of them.
    right = durable(plain(current.select("repo_id", "entity_type", "slug", "name", "payload", "anchors"))).groupBy("repo_id", "entity_type")
    return left.cogroup(right).applyInPandas(_resolve(largest_wins), OUTPUT)

