"""Functions, resolution, diff, search, serving, reconciliation and validation on small tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quarrygraph import schemas
from quarrygraph.functions import scalars as S
from quarrygraph.operators import diff, embed, resolve, search, semantic, serve, validate, wiki
from quarrygraph.operators.extract import extract_facts, javascript, python
from quarrygraph.sources import config, forge, git, tracker
from quarrygraph.streaming import reconcile


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    for said, want in (("A b!c", "a-b-c"), ("--", "unnamed"), ("", "unnamed"), ("Ünï", "n"), ("a_b.c", "a-b-c")):
        assert value(spark, S.slugify(F.lit(said))) == want
    assert value(spark, S.normalize_route(F.lit("/u/{id}/<x:int>"))) == "/u/{}/{}"
    assert value(spark, S.name_similarity(F.lit("Retry limit"), F.lit("limit, retry"))) == 1.0 and value(spark, S.name_similarity(F.lit("!"), F.lit("a"))) == 0.0
    assert value(spark, S.issue_keys(F.lit("KC-2 x AB1-3 KC-2 kc-9"))) == ["AB1-3", "KC-2"]
    assert value(spark, S.file_to_module(F.lit("a/b/__init__.py"))) == "a.b" and value(spark, S.file_to_module(F.lit("a/x.ts"))) == "a.x.ts"
    assert value(spark, S.is_test_component(F.array(F.lit("a/test_x.py"), F.lit("b.spec.ts")))) and not value(spark, S.is_test_component(F.array(F.lit("test_x.py"), F.lit("y.py"))))
    assert value(spark, S.payload_diff(F.lit('{"a":1,"b":null}'), F.lit('{"a":2,"c":[1]}'))).keys() == {"a", "c"}
    assert value(spark, S.kill_rate(F.lit(3), F.lit(0))) is None and value(spark, S.kill_rate(F.lit(1), F.lit(3))) == 0.3333
    assert value(spark, S.repo_lock_key(F.lit("x"))) == 2363233923
    assert value(spark, S.embedding_text(F.lit("business_rule"), F.lit("N"), F.lit('{"z":"last","a":"first","n":3,"l":["x"]}'))) == "business rule\nN\nfirst\nlast"


def test_anchors(spark):
    spots = lambda *items: F.array(*[F.struct(F.lit(f).alias("file_path"), F.lit(s).cast("string").alias("symbol_path"), F.lit(None).cast("struct<lo:int,hi:int>").alias("span")) for f, s in items])
    assert value(spark, S.anchor_overlap(spots(("a", "x"), ("a", "y")), spots(("a", "x")))) == 0.5
    assert value(spark, S.anchor_overlap(spots(("a", "x"), ("a", "y")), spots(("a", None)))) == 1.0
    moved = value(spark, S.map_anchor(spots(("p/a.py", "p.a.f"))[0], F.lit("q/b.py")))
    assert (moved.file_path, moved.symbol_path) == ("q/b.py", "q.b.f")


def test_resolution(spark):
    known = spark.createDataFrame([("r", p) for p in ("a", "a.b", "backend.db", "x.util", "y.util")], "repo_id string, path string")
    names = spark.createDataFrame([("r", n) for n in ("a.b.c", "a.z", "db", "util", "zzz", ".m")] + [("other", "a.b")], "repo_id string, name string")
    got = {(r.repo_id, r.name): (r.path, r.rule) for r in resolve.resolve(names, known).collect()}
    assert got == {("r", "a.b.c"): ("a.b", "prefix"), ("r", "a.z"): ("a", "prefix"), ("r", "db"): ("backend.db", "suffix")}


def _state(spark, *rows):
    spot = lambda f: [{"file_path": f, "symbol_path": None, "span": None}]
    return spark.createDataFrame([("r", slug, kind, name, "{}", h, spot(f), owner, [f]) for slug, kind, name, h, f, owner in rows], schemas.ENTITIES.rsplit(", first_run", 1)[0])


def test_diff_and_removal(spark):
    current = _state(spark, ("c/a", "component", "a", "1", "a.py", None), ("c/b", "component", "b", "1", "b.py", None), ("c/gone", "component", "g", "1", "g.py", None), ("rule/x", "business_rule", "x", "1", "a.py", None), ("w/x", "wiki_page", "x", "1", "", "rule/x"), ("pull-request/1", "pull_request", "1", "1", "a.py", None))
    candidate = _state(spark, ("c/a", "component", "a", "2", "a.py", None), ("c/b", "component", "b", "1", "b2.py", None), ("c/new", "component", "n", "1", "n.py", None))
    none = spark.createDataFrame([], schemas.EDGES)
    ops = lambda scope: {(r.slug, r.op) for r in diff.compute(candidate, none, current, none, scope)[0].collect()}
    base = {("c/a", "changed"), ("c/b", "moved"), ("c/new", "added")}
    assert ops(diff.Scope()) == base | {("c/gone", "removed")}
    assert ops(diff.Scope(True, frozenset({"deterministic", "llm"}))) == base | {("c/gone", "removed"), ("rule/x", "removed"), ("w/x", "removed")}
    assert ops(diff.Scope(False, frozenset({"deterministic"}), ("a.py",))) == base
    assert ops(diff.Scope(False, frozenset({"deterministic"}), ("g.py",))) == base | {("c/gone", "removed")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "red car"), (4, None), (5, "apple red")], "key long, body string")
    found = lambda q: {r.key for r in search.match(docs, q).collect()}
    assert found("red apple") == {1, 5} and found('"red apple"') == {1} and found("pie or car") == {1, 3} and found("apple -red") == {2} and found("") == set() == found("-red")
    top = [r.key for r in search.keyword(docs, "apple or pie", 2).collect()]
    assert top[0] == 1 and len(top) == 2
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.6, 0.8]), (9, [0.0, 0.0])], "key long, vector array<double>")
    query = spark.createDataFrame([([0.0, 1.0],)], "vector array<double>")
    assert [(r.key, r.score) for r in search.nearest(vectors, query, 5).collect()] == [(3, 0.8), (1, 0.0)]
    assert {r.key for r in search.hybrid(docs, vectors, "apple", query, 5).collect()} == {1, 2, 3, 5}
    assert {r.key for r in search.hybrid(docs, None, "apple", None, 5).collect()} == {1, 2, 5}


def test_coverage_states(spark):
    comps = spark.createDataFrame([("r", "component/a", ["a.py"], 0.3, 2), ("r", "component/b", ["b.py"], None, 5), ("r", "component/c", ["c.py"], None, 1), ("r", "component/t", ["test_t.py"], None, 1)], "repo_id string, slug string, files array<string>, kill_rate double, last_run int")
    tests = spark.createDataFrame([("r", "t/1", 3), ("r", "t/2", 4)], "repo_id string, slug string, last_run int")
    edges = spark.createDataFrame([("r", "covers", "t/1", "component/a"), ("r", "covers", "t/2", "component/b"), ("r", "depends_on", "component/t", "component/a"), ("r", "depends_on", "component/c", "component/a"), ("r", "defined_in", "api/x", "component/c")], schemas.EDGES)
    covered = serve.coverage(comps, edges, tests)
    got = {r.slug: (r.covered, r.stale, r.low_mutation_kill) for r in covered.collect()}
    assert got == {"component/a": (True, False, True), "component/b": (True, True, False), "component/c": (False, False, False), "component/t": (False, False, False)}
    targets = serve.impact_targets(comps, edges, comps, covered)
    assert {(r.target, r.verdict) for r in targets.where("slug = 'component/a'").collect()} == {("component/a", "low_kill"), ("component/c", "gap")}
    symbols = spark.createDataFrame([("r", "component/c", "c.f", "function")], "repo_id string, slug string, symbol_path string, kind string")
    steps = spark.createDataFrame([("r", "user-journey/j", "component/a"), ("r", "user-journey/j", "component/b")], "repo_id string, journey string, step string")
    needed = serve.step_components(steps, edges, comps.withColumn("entity_type", F.lit("component")))
    journeys = serve.journey_coverage(steps.select("repo_id", "journey").distinct(), needed, edges)
    assert [(r.n_components, r.covered_end_to_end) for r in journeys.collect()] == [(2, False)]
    plan = serve.test_plan(targets, covered, edges, symbols, journeys, steps)
    assert {(r.ordinal, r.target_kind, r.target) for r in plan.where("slug = 'component/a'").collect()} == {(1, "api", "api/x"), (3, "low_mutation_kill", "t/1"), (4, "journey", None)}
    entities = spark.createDataFrame([("r", "component/c"), ("r", "api/x")], "repo_id string, slug string")
    told = spark.createDataFrame([("r", "component/a", f"f{i}", c) for i, c in enumerate((None, ["nope", "api/x"], ["api/x"], []))], "repo_id string, slug string, test_file string, claims array<string>")
    scores = {r.test_file: r.score_pct for r in validate.score(told, plan, entities).collect()}
    assert scores["f0"] == 0.0 == scores["f3"] and 0 < scores["f1"] < scores["f2"] < 100


def test_entity_views(spark):
    entities = spark.createDataFrame([("r", "component/a", "component", "a"), ("r", "api/x", "api", "x")], "repo_id string, slug string, entity_type string, name string")
    edges = spark.createDataFrame([("r", "defined_in", "api/x", "component/a"), ("r", "documents", "wiki-page/a", "component/a")], schemas.EDGES)
    proof = spark.createDataFrame([("r", i, "component/a", "component_observed") for i in range(8)], "repo_id string, compile_run_id int, slug string, fact_type string")
    runs = spark.createDataFrame([("r", 1, "succeeded", "s1", False), ("r", 2, "failed", "s2", False)], "repo_id string, compile_run_id int, status string, commit_sha string, degraded boolean")
    one = serve.get_entity(entities, edges, proof, "component/a").first()
    assert [tuple(r) for r in one.relations] == [("in", "defined_in", "api/x")] and [p.compile_run_id for p in one.provenance] == [7, 6, 5, 4, 3]
    row = serve.stats(entities, edges, runs).first()
    assert row.entity_counts == {"api": 1, "component": 1} and row.n_edges == 2 and row.last_run.compile_run_id == 1


def test_reconcile_order(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    kind = "repo_id string, kind string, key string, ts timestamp, sha string"
    prs = spark.createDataFrame([("r", "pr", "2", t(3), "m2"), ("r", "pr", "1", t(2), "m1")], kind)
    commits = spark.createDataFrame([("r", "commit", "c1", t(2), "c1"), ("r", "commit", "m1", t(2), "m1"), ("r", "commit", "c0", t(1), "c0")], kind)
    units = reconcile.merge_streams(prs, commits, F.lit(t(1)))
    done: list[tuple] = []
    table = lambda: spark.createDataFrame(done, "repo_id string, status string, scope string, key string, sha string, merged_at timestamp, commit_timestamp timestamp")

    def one(unit):
        if unit["key"] == "2" and not any(d[3] == "x" for d in done):
            raise RuntimeError("stop")
        done.append(("r", "succeeded", unit["kind"], unit["key"], unit["sha"], unit["ts"], None))

    with pytest.raises(RuntimeError):
        reconcile.reconcile(units, table, one)
    assert [d[3] for d in done] == ["1", "c1"]
    done.append(("r", "failed", "pr", "x", None, None, None))
    assert reconcile.reconcile(units, table, one) == ["1", "c1", "2"] and [d[3] for d in done if d[1] == "succeeded"] == ["1", "c1", "2"]
    assert reconcile.watermark(table()).first()["watermark"] == t(3)


def test_streamed_units(spark, tmp_path):
    rows = [("r", "pr", str(i), datetime.datetime(2024, 1, 1, i), f"s{i}") for i in (3, 1, 2)]
    spark.createDataFrame(rows, "repo_id string, kind string, key string, ts timestamp, sha string").coalesce(1).write.parquet(str(tmp_path / "in"))
    done = []
    table = lambda: spark.createDataFrame(done, "repo_id string, status string, scope string, key string, sha string")
    stream = spark.readStream.schema("repo_id string, kind string, key string, ts timestamp, sha string").parquet(str(tmp_path / "in"))
    one = lambda u: done.append(("r", "succeeded", u["kind"], u["key"], u["sha"]))
    for _ in range(2):
        reconcile.stream_units(stream, table, one, str(tmp_path / "ck")).awaitTermination(60)
    assert [d[3] for d in done] == ["1", "2", "3"]


def test_extraction(spark):
    rows = [("r", "f", "pkg/__init__.py", "", "import os\n"), ("r", "f", "bad.py", "", "def ok(:\nimport x.y\nclass K:\n"), ("r", "f", "tsconfig.json", "", '{ // c\n "compilerOptions": {"paths": {"@/*": ["./src/*"]},} }'), ("r", "f", "src/a.ts", "", 'import {x} from "@/lib/b";\nexport class C { run(a: string): void { } }\ndescribe("d", () => { it("x", () => {}) });\n'), ("r", "f", "w/t.spec.js", "", 'const b = require("./b");\ndescribe("d", () => { it.skip("in", () => {}); });\nmodule.exports = { f() { } };\n'), ("r", "f", "none.py", "", None), ("r", "f", "a.md", "", "x")]
    facts = extract_facts(spark.createDataFrame(rows, schemas.ARTIFACTS)).collect()
    has = lambda fact_type, **want: any(f.fact_type == fact_type and want.items() <= json.loads(f.payload).items() for f in facts)
    assert has("component_observed", path="pkg", kind="package") and has("dependency_observed", from_path="bad", to_path="x.y") and has("symbol_observed", symbol_path="bad.K", kind="class")
    assert has("dependency_observed", to_path="src.lib.b") and has("symbol_observed", symbol_path="src.a.C.run", kind="method")
    assert has("test_case_observed", node_id="w/t.spec.js::in") and has("symbol_observed", symbol_path="w.t.spec.f") and has("dependency_observed", to_path="w.b")
    assert python.external_keys("# kc:external-key: K1\n\n@d\ndef f(): pass\n# kc:external-key: K2\nx = 1\ndef g(): pass\n# kc:external-key: K3\nclass A: pass") == {"f": "K1", "A": "K3"}
    assert javascript.match_alias("@/a", {"@/*": ["./s/*"]}) == "./s/a" and javascript.match_alias("q", {"q": []}) is None


def test_semantic(spark):
    arts = spark.createDataFrame([("r", "f", "m.py", "", "# kc:external-key: R-1\ndef f(): pass\n"), ("r", "f", "n.py", "", "x = 1\n"), ("r", "f", "test_m.py", "", "def test_a(): pass\n")], schemas.ARTIFACTS)
    facts = extract_facts(arts)
    cache = spark.createDataFrame([], schemas.LLM_CACHE)
    answer = {"business_rules": [{"name": "R", "statement": "s", "intent": "i", "symbol_paths": ["m.f", "nope"], "related_components": ["m"]}], "features": [], "risks": []}
    provider = semantic.Scripted({"def f": json.dumps(answer), "x = 1": '{"odd": 1}'})
    made, fresh, warnings = semantic.extract_semantic(arts, facts, cache, provider, "m1")
    rule = made.collect()
    assert len(rule) == 1 and json.loads(rule[0].payload)["external_key"] == "R-1" and rule[0].anchors[0].symbol_path == "m.f"
    assert warnings.count() == 1 and fresh.count() == 1
    stored = spark.createDataFrame([tuple(r) for r in fresh.collect()], schemas.LLM_CACHE)
    again, more, _ = semantic.extract_semantic(arts, facts, stored, semantic.Scripted({}), "m1")
    assert again.count() == 1 and more.count() == 1
    with pytest.raises(semantic.BudgetError):
        semantic.extract_semantic(arts, facts, cache, provider, "m1", budget=1)
    stories = spark.createDataFrame([("K-1", "pay", "", "s", "t")], "key string, summary string, description string, status string, issue_type string")
    features = spark.createDataFrame([("Pay", "n")], "name string, narrative string")
    linked, kept = semantic.link_stories(stories, features, cache, semantic.Scripted({"pay": '{"motivates": ["Pay", "Other"]}'}), "m1", "r")
    assert json.loads(linked.first().payload) == {"jira_key": "K-1", "feature_names": ["Pay"]} and kept.count() == 1


def test_embeddings(spark):
    class Broken(embed.HashEmbedder):
        def embed(self, texts):
            raise OSError("down")

    entities = _state(spark, ("c/a", "component", "a", "1", "a.py", None), ("w/a", "wiki_page", "a", "1", "", "c/a"))
    none = spark.createDataFrame([], schemas.EMBEDDINGS)
    down = embed.embed(entities, none, Broken()).collect()
    assert [(r.slug, r.status, r.vector) for r in down] == [("c/a", "pending", None)]
    up = embed.embed(entities, spark.createDataFrame([tuple(r) for r in down], schemas.EMBEDDINGS), embed.HashEmbedder()).collect()
    assert [(r.slug, r.status, len(r.vector)) for r in up] == [("c/a", "current", 8)]
    assert search.backfill_todo(embed.texts(entities), spark.createDataFrame([tuple(r) for r in up], schemas.EMBEDDINGS), "hash-8").count() == 0


def test_pages(spark, tmp_path):
    entities = _state(spark, ("component/a", "component", "a", "1", "a.py", None), ("component/b", "component", "b", "1", "b.py", None), ("wiki-page/component-a", "wiki_page", "a", "1", "", "component/a"))
    edges = spark.createDataFrame([("r", "depends_on", "component/a", "component/b")], schemas.EDGES)
    deltas = spark.createDataFrame([("r", i, "component/a", "component", "changed", {}, {}) for i in range(7)], schemas.DELTAS)
    made = wiki.pages(entities, edges, deltas)
    text = made.first()["text"]
    assert made.count() == 1 and "## Depends on" in text and "[b](b.md)" in text and "run 6" in text and "run 1" not in text
    wiki.emit(made, str(tmp_path))
    (tmp_path / "component" / "old.md").write_text("x")
    assert wiki.prune(spark, entities, str(tmp_path)) == ["component/old.md"] and (tmp_path / "component" / "a.md").exists()
    assert wiki.pages(entities, edges, deltas, spark.createDataFrame([], "repo_id string, slug string")).count() == 0
    files = [("a.md", text), ("log.md", "---\nx: 1\n---\n"), ("index.md", "---\nokf_version: 1\nextra: 2\n---\n"), ("d/n.md", "no front"), ("t.md", "---\nname: x\n---\n"), ("ok/index.md", "# x")]
    issues = {(r.path, r.rule) for r in wiki.conformance(spark.createDataFrame(files, "path string, text string")).collect()}
    assert issues == {("log.md", "log.md-frontmatter"), ("index.md", "index.md-frontmatter"), ("d/n.md", "missing-frontmatter"), ("t.md", "missing-type")}


def test_sources(spark, tmp_path):
    assert git.artifact("r", "b", b"\0x") is None and git.artifact("r", "t", b"\xff")[4] == "\ufffd"
    git._git(str(tmp_path), "init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git._git(str(tmp_path), "add", "a.py")
    git._git(str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@e", "commit", "-qm", "m")
    sha = git.head_commit(str(tmp_path))
    assert [r.source_ref for r in git.working_tree(spark, str(tmp_path), "r").collect()] == ["a.py"]
    assert [r.content for r in git.at_commit(spark, str(tmp_path), "r", sha, ["a.py", "gone.py"]).collect()] == ["x = 1\n"]
    with pytest.raises(RuntimeError):
        git.head_commit(str(tmp_path / "nowhere"))
    (tmp_path / "j.json").write_text(json.dumps({"K-1": {"summary": "s"}, "K-2": {"summary": "t"}}))
    issues = tracker.configured(spark, {"enabled": True, "source": "file", "path": "j.json"}, str(tmp_path), ["K-2", "K-9", "K-2"])
    assert [(r.key, r.summary) for r in issues.collect()] == [("K-2", "t")]
    assert tracker.configured(spark, {}, "", []) is None and tracker.rich_text({"content": [{"type": "text", "text": "a"}, {"content": [{"type": "text", "text": "b"}]}]}) == "a b"
    assert config.write_config(str(tmp_path), "demo") and not config.write_config(str(tmp_path), "demo")
    (tmp_path / "more.toml").write_text('[[journeys]]\nname = "B"\nsteps = ["y", "x"]\n')
    read = config.read_config(str(tmp_path))
    assert config.journeys({**read, "journeys": [{"name": "A", "steps": []}], "journeys_file": "more.toml"}, str(tmp_path)) == [("A", []), ("B", ["y", "x"])]
    (tmp_path / "mutation.json").write_text('{"b": {"killed": 1}, "a": {}}')
    assert config.mutation_scores(str(tmp_path)) == [("a", 0, 0, 0), ("b", 1, 0, 0)]

    class Answers:
        def __init__(self, url):
            self.url = url

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self):
            if "/files" in self.url:
                return json.dumps([{"filename": "n.py", "status": "renamed", "previous_filename": "o.py"}]).encode()
            return json.dumps([{"number": n, "title": "t", "body": None, "merged_at": at, "merge_commit_sha": "s"} for n, at in ((2, "2024-01-02T00:00:00Z"), (1, "2024-01-01T00:00:00Z"), (3, None))]).encode()

    import os

    os.environ["FORGE_TOKEN"] = "x"
    rest = forge.RestForge("http://h", "o/r", opener=lambda request: Answers(request.full_url))
    rows = rest.merged_prs(spark, "main", datetime.datetime(2024, 1, 1)).collect()
    assert [(r.number, r.files[0].old_path) for r in rows] == [(2, "o.py")]


def test_claims():
    assert validate.parse_claims('"""x\n\nkc-covers:\n- a/b\n - c/d\n\n- e\n"""') == ["a/b", "c/d"]
    assert validate.parse_claims("x = 1") is None and validate.parse_claims('"""kc-covers:\n"""') == []
