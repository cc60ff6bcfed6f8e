"""Every registered query against its SQL twin, and the cascade against a sequential model."""

import itertools
import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from quarrygraph.operators import cascade as C
from quarrygraph.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_as_sql_has_it(spark, duck, name):
    frame = registry.QUERIES[name](spark, DIR)
    cols = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=repr)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert got == want


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "coverage_for_all" in entry.queries()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_a_twin(spark, name):
    frame = registry.QUERIES[name](spark, DIR)
    assert frame.count() > 0 and len(frame.limit(5).collect()) == 5


def sequential(known, candidates):
    """The cascade without indices, groups or Spark."""
    state = {k: {"name": n, "payload": p, "anchors": set(a), "touched": False} for k, n, p, a in known}
    for h, name, payload, anchors in sorted(candidates):
        payload, anchors = json.loads(payload), set(anchors)
        if not anchors:
            continue
        hit = None
        if payload.get("external_key"):
            hit = min((s for s, e in state.items() if e["payload"].get("external_key") == payload["external_key"]), default=None)
        if hit is None:
            hit = max(((len(anchors & e["anchors"]) / len(anchors), s) for s, e in state.items() if len(anchors & e["anchors"]) / len(anchors) >= 0.5), default=(0, None))[1]
        if hit is None:
            near = []
            for s, e in state.items():
                a, b = C._tokens(name), C._tokens(e["name"])
                if a and b and set(payload["related_components"]) & set(e["payload"]["related_components"]) and len(a & b) / len(a | b) >= 0.8:
                    near.append((len(a & b) / len(a | b), s))
            hit = max(near, default=(0, None))[1]
        if hit is None:
            base = "feature/" + C._slugify(name)
            hit = next(s for s in itertools.chain([base], (f"{base}-{i}" for i in itertools.count(2))) if s not in state)
            state[hit] = {"name": name, "payload": payload, "anchors": anchors, "touched": True}
            continue
        e = state[hit]
        if not e["touched"]:
            e.update(name=name, payload=payload, anchors=anchors, touched=True)
        else:
            if (len(anchors), C._hash(payload)) > (len(e["anchors"]), C._hash(e["payload"])):
                e["payload"] = payload
            e["name"], e["anchors"] = e["payload"].get("name", e["name"]), e["anchors"] | anchors
    return {s: (e["name"], sorted(e["anchors"])) for s, e in state.items() if e["touched"]}


_NAMES = st.sampled_from(["retry limit", "limit retry", "retry limit two", "plan price", "price", "!", "retry-limit"])
_ROWS = st.tuples(_NAMES, st.lists(st.sampled_from("abcd"), max_size=3, unique=True), st.lists(st.sampled_from(["m", "n"]), max_size=2, unique=True), st.sampled_from([None, "K1", "K2"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(_ROWS, max_size=8), st.lists(_ROWS, max_size=12))
def test_cascade_model(known, rows):
    def payload(name, comps, key):
        return {"name": name, "related_components": comps, **({"external_key": key} if key else {})}

    before = [(f"feature/k{i}", n, payload(n, c, k), [(f, None) for f in fs]) for i, (n, fs, c, k) in enumerate(known)]
    cands = [(C._hash({"i": i}), n, json.dumps(payload(n, c, k)), [(f, None) for f in fs]) for i, (n, fs, c, k) in enumerate(rows)]
    state = C.Resolver("feature", [C._Known(s, n, p, frozenset(a)) for s, n, p, a in before])
    for h, n, p, a in sorted(cands):
        if a:
            state.take(n, json.loads(p), frozenset(a), h)
    got = {k.slug: (k.name, sorted(k.anchors)) for k in state.known.values() if k.touched}
    assert got == sequential(before, cands)


def test_cascade_ignores_the_order_of_rows(spark):
    rows = [("r", "feature", f"name {i % 4}", json.dumps({"name": f"name {i % 4}", "related_components": ["m"]}), f"{i * 7919 % 101:03d}", [{"file_path": f"f{i % 5}", "symbol_path": None}] if i % 6 else []) for i in range(24)]
    kind = "repo_id string, entity_type string, name string, payload string, content_hash string, anchors array<struct<file_path:string,symbol_path:string>>"
    none = spark.createDataFrame([], kind + ", slug string")
    first = sorted(map(str, C.match_or_mint(spark.createDataFrame(rows, kind), none).collect()))
    assert sorted(map(str, C.match_or_mint(spark.createDataFrame(rows[::-1], kind).repartition(3), none).collect())) == first
    assert sum("missing anchors" in r for r in first) == 4
