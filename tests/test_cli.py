"""Commands over a small repository, the tool server and the published branch."""

import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrygraph import cli, compiler, interfaces, schemas, server
from quarrygraph.operators.embed import HashEmbedder
from quarrygraph.operators.publish import Branch
from quarrygraph.operators.semantic import BudgetError, Scripted
from quarrygraph.operators.store import Store
from quarrygraph.service import Graph

from .test_compile import FILES, artifacts

RULE = json.dumps({"business_rules": [{"name": "Limit", "statement": "a", "intent": "b", "symbol_paths": ["billing.rules.limit"], "related_components": ["billing.rules"]}], "features": [{"name": "Plans", "narrative": "n", "symbol_paths": [], "related_components": ["billing.api"]}], "risks": []})


def git(folder, *words):
    return subprocess.run(["git", "-C", str(folder), *words], capture_output=True, check=True, text=True).stdout.strip()


@pytest.fixture
def repo(tmp_path):
    folder = tmp_path / "repo"
    for name, text in FILES.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    git(tmp_path, "init", "-q", "repo")
    git(folder, "config", "user.email", "a@b")
    git(folder, "config", "user.name", "a")
    git(folder, "add", "-A")
    git(folder, "commit", "-qm", "one")
    return folder


def test_commands(spark, repo, capsys):
    run = lambda *words: cli.main(["--repo", str(repo), *words])
    assert run("init", "bill") == 0 and run("init", "bill") == 0
    with open(repo / "kc.toml", "a") as f:
        f.write('\n[publisher]\nenabled = true\npush = false\n[embeddings]\nenabled = true\nprovider = "hash"\n[jira]\nenabled = true\nsource = "file"\npath = "issues.json"\n')
    (repo / "issues.json").write_text(json.dumps({"KC-1": {"summary": "s", "status": "open", "description": "d", "issue_type": "Story"}}))
    capsys.readouterr()
    assert run("compile") == 0
    said = capsys.readouterr()
    assert "published" in said.out and "vectors" in said.out and said.err == ""
    assert (repo / "wiki" / "index.md").exists() and "component" in git(repo, "show", "knowledge/wiki:index.md") and git(repo, "status", "--porcelain", "--untracked-files=no") == ""
    assert (repo / "wiki" / "index" / "component-1.md").exists() and "added" in (repo / "wiki" / "recent-changes.md").read_text()
    assert run("validate-okf") == 0
    store = Store(spark, str(repo / ".graph"))
    assert store.read("entities").where("slug = 'jira-story/kc-1'").count() == 1
    assert run("verify") == 0 and run("inspect") == 0 and run("compile", "--emit-only") == 0
    (repo / "t.py").write_text('"""x\n\nkc-covers:\n- api/get-plans\n- component/none\n"""\n')
    capsys.readouterr()
    assert run("validate-test", str(repo / "t.py"), "--for-entity", "component/billing-rules") == 1
    assert json.loads(capsys.readouterr().out)["nonexistent"] == ["component/none"]
    assert run("validate-test", str(repo / "t.py"), "--for-entity", "component/zzz") == 1


def test_steps_of_a_compile(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "w").mkdir()
    git(tmp_path, "init", "-q", "g")
    story = [("r", "jira_observed", {"key": "KC-1", "summary": "plans", "status": "x", "description": "", "issue_type": "Story", "linked_pr": None}, [])]
    provider = Scripted({"def limit": RULE, "KC-1": '{"motivates": ["Plans"]}'})
    with pytest.raises(BudgetError):
        compiler.compile_run(spark, store, "r", "bill", artifacts(spark, FILES), steps=compiler.Steps(provider, "m", 1))
    assert store.read("llm_cache").count() == 1 and store.read("runs").where("status = 'failed'").count() == 1
    branch = Branch(str(tmp_path / "g"), push=False)
    steps = compiler.Steps(provider, "m", 10, True, HashEmbedder(), str(tmp_path / "w"), branch)
    done = compiler.compile_run(spark, store, "r", "bill", artifacts(spark, FILES), more=compiler.extra_fact(spark, story), steps=steps)
    assert not done.degraded and done.changes["added"] == done.entities and done.pages > 0 and done.vectors > 0 and done.published
    assert store.read("edges").where("relation_type = 'motivates' AND to_slug = 'feature/plans'").count() == 1
    assert store.read("facts").where("fact_type = 'business_rule_candidate'").count() == 1 and store.read("artifacts").count() == len(FILES)
    again = compiler.compile_run(spark, store, "r", "bill", artifacts(spark, FILES), more=compiler.extra_fact(spark, story), steps=compiler.Steps(Scripted({}), "m", 0, True, HashEmbedder(), str(tmp_path / "w"), branch))
    assert again.changes == {} and again.vectors == done.vectors and again.published != done.published  # the log has a line more
    assert branch.publish(str(tmp_path / "w"), "the same pages") is None and git(tmp_path / "g", "rev-parse", "knowledge/wiki") == again.published
    assert store.read("embeddings").count() == done.vectors

    class Out:
        def complete(self, prompt, schema_name):
            raise RuntimeError("out")

        model_id = "x"

        def embed(self, texts):
            raise RuntimeError("out")

    broken = compiler.compile_run(spark, store, "r", "bill", artifacts(spark, FILES), steps=compiler.Steps(Out(), "other", 10, True, Out(), "/proc/none"))
    assert broken.degraded and any("pages failed" in w for w in broken.warnings) and store.read("entities").where("slug = 'business-rule/limit'").count() == 1

    graph = Graph(store, "r")
    ask = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}]
    ask += [{"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "list_entities", "arguments": {"entity_type": "api"}}}, {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_entity"}}, {"jsonrpc": "2.0", "id": 5, "method": "x"}]
    out = io.StringIO()
    server.serve(graph, [json.dumps(a) for a in ask] + ["{"], out)
    told = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [t["id"] for t in told] == [1, 2, 3, 4, 5, None] and len(told[1]["result"]["tools"]) == 12
    assert json.loads(told[2]["result"]["content"][0]["text"])[0]["slug"] == "api/get-plans"
    assert told[3]["error"]["code"] == -32602 and told[4]["error"]["code"] == -32601
    with pytest.raises(LookupError):
        server.serve(Graph(store, "nobody"), [])


def test_registry():
    assert isinstance(interfaces.make("embedder", "hash"), HashEmbedder)
    with pytest.raises(LookupError):
        interfaces.make("embedder", "none")
    with pytest.raises(ValueError):
        interfaces.register("embedder", "x", HashEmbedder, version="0")
    with pytest.raises(ValueError):
        interfaces.register("odd", "x", HashEmbedder)
