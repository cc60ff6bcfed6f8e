"""The twelve questions over a compiled repository."""

from quarrygraph import compiler
from quarrygraph.operators.diff import Scope
from quarrygraph.operators.embed import HashEmbedder, embed
from quarrygraph.operators.store import Store
from quarrygraph.service import Graph
from quarrygraph import schemas

from .test_compile import FILES, artifacts


def test_questions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    spot = [{"file_path": "billing/rules.py", "symbol_path": "billing.rules.limit", "span": None}]
    more = compiler.extra_fact(spark, [("r", "business_rule_candidate", {"name": "Limit", "statement": "a", "intent": "b", "related_components": ["billing.rules"]}, spot), ("r", "user_journey_observed", {"name": "Buy", "steps": ["api/get-plans", "component/billing-rules"]}, [])])
    files = {**FILES, "billing/api.py": "import sqlalchemy.orm\n" + FILES["billing/api.py"]}
    compiler.compile_once(spark, store, "r", "bill", artifacts(spark, files), Scope(True, frozenset({"deterministic", "llm"})), more, {"sha": "abc"})
    graph = Graph(store, "r", [(0, "sqlalchemy", "orm-repo")])
    assert [r.slug for r in graph.search_knowledge("limit", "business_rule").collect()] == ["business-rule/limit"]
    vectors = embed(graph.entities, spark.createDataFrame([], schemas.EMBEDDINGS), HashEmbedder())
    assert Graph(store, "r", vectors=vectors, embedder=HashEmbedder()).search_knowledge("limit", limit=3).count() == 3
    one = graph.get_entity("component/billing-api").first()
    assert [tuple(x) for x in one.cross_repo_dependencies] == [("sqlalchemy.orm", "orm-repo")] and ("out", "depends_on", "component/billing-rules") in [tuple(x) for x in one.relations]
    assert graph.get_entity("component/none").count() == 0
    assert [r.slug for r in graph.list_entities("api").collect()] == ["api/get-plans"]
    assert graph.recent_changes().first().n_changes == graph.entities.count()
    row = graph.which_pr_introduced("component/billing").first()
    assert row.pr_number is None and row.note and row.commit_sha == "abc"
    assert graph.linked_context("component/billing-rules").first().business_rules == ["business-rule/limit"] and graph.linked_context("component/none").first().risks == []
    assert graph.coverage_for("component/billing-rules").first().covered and not graph.coverage_for("component/billing-api").first().covered
    plan = {(r.relation, r.affected): r.verdict for r in graph.impact_plan("component/billing-rules").collect()}
    assert plan == {("depends_on", "component/billing-api"): "gap", ("depends_on", "component/tests-test-rules"): None, ("governs", "business-rule/limit"): None, ("self", "component/billing-rules"): "ok"}
    assert not graph.journey_coverage("user-journey/buy").first().covered_end_to_end
    told = [(r.target_kind, r.component, r.target) for r in graph.test_plan("component/billing-rules").collect()]
    assert told == [("api", "component/billing-api", "api/get-plans"), ("journey", "user-journey/buy", None)]
    assert graph.resolve_dependency("sqlalchemy.orm").first().repo_slug == "orm-repo" and graph.resolve_dependency("x").count() == 0
    stats = graph.knowledge_stats().first()
    assert stats.entity_counts["business_rule"] == 1 and stats.last_run.commit_sha == "abc"
    assert graph.emit(str(tmp_path / "wiki")) == [] and (tmp_path / "wiki" / "index.md").exists() and "Governed by" in (tmp_path / "wiki" / "component" / "billing-rules.md").read_text()
