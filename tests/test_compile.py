"""Compiling a tiny repository: full, again, incrementally, and in shadow."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarrygraph import compiler, schemas
from quarrygraph.operators.diff import Scope
from quarrygraph.operators.store import LockedError, Store

FILES = {
    "billing/__init__.py": "",
    "billing/rules.py": "def limit(x):\n    return x\n\n\nclass Plan:\n    def price(self):\n        return 1\n",
    "billing/api.py": "import billing.rules\n\n\n@app.get('/plans/{id}')\ndef plan(id):\n    return billing.rules.limit(id)\n",
    "tests/test_rules.py": "from billing.rules import limit\n\n\ndef test_limit():\n    assert limit(1)\n",
}


def artifacts(spark, files):
    return spark.createDataFrame([("r", "file", k, "", v) for k, v in files.items()], schemas.ARTIFACTS)


def edges(store):
    return {(r.relation_type, r.from_slug, r.to_slug) for r in store.read("edges").collect()}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_full_then_nothing_new(spark, store):
    run = compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES))
    slugs = {r.slug for r in store.read("entities").collect()}
    assert {"project/bill", "component/billing", "component/billing-rules", "api/get-plans", "test-coverage/tests-test-rules-py-test-limit", "wiki-page/component-billing-api"} <= slugs
    found = edges(store)
    assert ("covers", "test-coverage/tests-test-rules-py-test-limit", "component/billing-rules") in found
    assert ("depends_on", "component/billing-api", "component/billing-rules") in found
    assert ("contains", "component/billing", "component/billing-rules") in found
    assert ("contains", "project/bill", "component/billing") in found
    assert ("defined_in", "api/get-plans", "component/billing-api") in found
    assert ("documents", "wiki-page/api-get-plans", "api/get-plans") in found
    second = compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES))
    assert store.read("deltas").where(F.col("compile_run_id") == second).count() == 0
    assert store.read("deltas").where(F.col("compile_run_id") == run).count() == len(slugs)
    assert compiler.verify(spark, store, "r", "bill", artifacts(spark, FILES)).count() == 0


def test_slices_equal_a_full_compile(spark, store):
    compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES))
    now = dict(FILES)
    now["billing/rules.py"] = "import billing.api\n\n\ndef limit(x, y):\n    return x\n"
    del now["tests/test_rules.py"]
    day = datetime.datetime(2024, 1, 2)
    prs = spark.createDataFrame([(7, "KC-1", None, day, "abc", [("billing/rules.py", "modified", None)]), (8, "rm", None, day + datetime.timedelta(1), "def", [("tests/test_rules.py", "removed", None)])], schemas.MERGED_PRS)
    commits = spark.createDataFrame([("abc", day, "", ["billing/rules.py"])], schemas.COMMITS)

    def at(unit, paths):
        return artifacts(spark, {p: now[p] for p in paths if p in now} or {"none.txt": ""})

    assert compiler.reconcile_changes(spark, store, "r", "bill", prs, commits, at, "8") == ["7", "8"]
    slugs = {r.slug for r in store.read("entities").collect()}
    assert "pull-request/7" in slugs and "test-coverage/tests-test-rules-py-test-limit" not in slugs and "component/billing-api" in slugs
    assert ("depends_on", "component/billing-rules", "component/billing-api") in edges(store)
    assert compiler.reconcile_changes(spark, store, "r", "bill", prs, commits, at) == []
    assert compiler.verify(spark, store, "r", "bill", artifacts(spark, now)).count() == 0
    with pytest.raises(LookupError):
        compiler.reconcile_changes(spark, store, "r", "bill", prs, commits, at, "99")


def test_candidates_and_failure(spark, store):
    spot = [{"file_path": "billing/rules.py", "symbol_path": "billing.rules.limit", "span": None}]
    rows = [
        ("r", "business_rule_candidate", {"name": "Limit", "statement": "a", "intent": "b", "related_components": ["billing.rules"]}, spot),
        ("r", "feature_candidate", {"name": "Plans", "narrative": "n", "related_components": ["billing.api", "sqlalchemy"]}, spot),
        ("r", "risk_candidate", {"name": "Loose", "description": "d", "category": "c", "related_components": []}, []),
        ("r", "user_journey_observed", {"name": "Buy", "steps": ["api/get-plans", "component/none", "feature/plans"]}, []),
        ("r", "mutation_score_observed", {"module": "billing.rules", "killed": 3, "survived": 7, "timeout": 0}, []),
        ("r", "jira_observed", {"key": "KC-1", "summary": "s", "status": "x", "description": "", "issue_type": "Story", "linked_pr": None}, []),
        ("r", "jira_feature_link_observed", {"jira_key": "KC-1", "feature_names": ["Plans"]}, []),
    ]
    more = compiler.extra_fact(spark, rows)
    scope = Scope(True, frozenset({"deterministic", "llm"}))
    state, *_ = compiler.compile_state(spark, store, "r", "bill", artifacts(spark, FILES), scope, more)
    said = sorted(r.warning for r in state.warnings.collect())
    assert said == ["journey 'Buy' drops unknown step 'component/none'", "rejected risk 'Loose': missing anchors"]
    compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES), scope, more)
    found = edges(store)
    assert ("governs", "business-rule/limit", "component/billing-rules") in found
    assert ("implemented_by", "feature/plans", "component/billing-api") in found
    assert ("traverses", "user-journey/buy", "feature/plans") in found
    assert ("motivates", "jira-story/kc-1", "feature/plans") in found
    rate = store.read("entities").where("slug = 'component/billing-rules'").select(F.get_json_object("payload", "$.mutation_kill_rate").alias("x")).first()["x"]
    assert float(rate) == 0.3
    # A run without the semantic family removes nothing of it.
    compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES))
    assert store.read("entities").where("slug = 'business-rule/limit'").count() == 1
    with store.lock("bill"), pytest.raises(LockedError):
        compiler.compile_once(spark, store, "r", "bill", artifacts(spark, FILES))
    broken = artifacts(spark, FILES).withColumn("content", F.raise_error(F.lit("lost")))
    before = len(store.versions())
    with pytest.raises(Exception, match="lost"):
        compiler.compile_once(spark, store, "r", "bill", broken)
    assert store.read("runs").where("status = 'failed'").count() == 1 and len(store.versions()) == before + 1
    assert store.read("entities").where("slug = 'business-rule/limit'").count() == 1


def test_two_repositories_at_once(spark, store):
    """Both claim their numbers and read the state before either commits; neither loses the other's rows."""
    first, second = store.next_version(), store.next_version()
    assert first != second

    def state(repo):
        one = spark.createDataFrame([(repo, f"component/{repo}", "component", repo)], "repo_id string, slug string, entity_type string, name string")
        wanted = spark.createDataFrame([], schemas.ENTITIES).schema
        none = spark.createDataFrame([], schemas.EDGES)
        return {"entities": one.select(*[F.col(f.name) if f.name in one.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]), "edges": none}

    store.commit(second, "b", state("b"))
    store.commit(first, "a", state("a"))
    assert {r.slug for r in store.read("entities").collect()} == {"component/a", "component/b"}
    store.commit(store.next_version(), "a", {})  # a failed run leaves the state
    assert store.read("entities").count() == 2
    with pytest.raises(ValueError):
        store.commit(first, "a", state("a"))


def test_a_lock_outlives_its_lease(store):
    with store.lock("r"), pytest.raises(LockedError), store.lock("r"):
        pass
    held = store.lock("r")
    held.__enter__()
    with pytest.raises(LockedError), store.lock("r"):
        pass
    with store.lock("r", lease_seconds=-1):
        pass
