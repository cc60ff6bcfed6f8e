"""Table schemas of the knowledge graph, as DDL. Slugs are the keys; every table carries repo_id."""

ANCHOR = "struct<file_path:string,symbol_path:string,span:struct<lo:int,hi:int>>"
ARTIFACTS = "repo_id string, artifact_type string, source_ref string, content_hash string, content string"
FACTS = f"repo_id string, fact_type string, payload string, artifact_refs array<string>, extractor string, content_hash string, anchors array<{ANCHOR}>"
ENTITIES = f"repo_id string, slug string, entity_type string, name string, payload string, content_hash string, anchors array<{ANCHOR}>, owner_slug string, files array<string>, first_run int, last_run int"
EDGES = "repo_id string, relation_type string, from_slug string, to_slug string"
RUNS = "repo_id string, compile_run_id int, scope string, key string, pr_number int, sha string, merged_at timestamp, commit_timestamp timestamp, status string, degraded boolean, error string, started_at timestamp, finished_at timestamp, versions map<string,string>"
DELTAS = "repo_id string, compile_run_id int, slug string, entity_type string, op string, summary map<string,struct<old:string,new:string>>, evidence map<string,string>"
EDGE_DELTAS = "repo_id string, compile_run_id int, relation_type string, from_slug string, to_slug string, op string"
PROVENANCE = "repo_id string, compile_run_id int, slug string, fact_type string, artifact_refs array<string>, extractor string, rule string"
EMBEDDINGS = "repo_id string, slug string, model_id string, vector array<float>, content_hash string, status string"
LLM_CACHE = "cache_key string, template_id string, template_version string, model_id string, output string"
CONFLICTS = "repo_id string, compile_run_id int, slug string, kind string, values array<string>"
WARNINGS = "repo_id string, compile_run_id int, warning string"
RUN_FACTS = f"compile_run_id int, {FACTS}"
RUN_ARTIFACTS = "repo_id string, compile_run_id int, artifact_type string, source_ref string, content_hash string"
REPOSITORIES = "repo_id string, repo_slug string, default_branch string"
MERGED_PRS = "number int, title string, body string, merged_at timestamp, merge_commit_sha string, files array<struct<path:string,change:string,old_path:string>>"
COMMITS = "sha string, timestamp timestamp, message string, files array<string>"
JIRA = "key string, summary string, status string, description string, issue_type string"
MUTATION = "module string, killed int, survived int, timeout int"

#: Versions that every run records (fixed values).
VERSIONS = {"facts": "1", "model": "1", "pages": "0.2"}
#: The graph's closed vocabularies (fixed values).
ENTITY_TYPES = ("project", "component", "api", "test_coverage", "pull_request", "jira_story", "feature", "business_rule", "risk", "wiki_page", "user_journey")
RELATION_TYPES = ("implemented_by", "exposes", "governs", "verified_by", "covers", "defined_in", "depends_on", "contains", "affects", "motivates", "documents", "traverses")
FACT_TYPES = ("component_observed", "symbol_observed", "dependency_observed", "api_endpoint_observed", "test_case_observed", "test_target_observed", "source_change_observed", "pr_observed", "jira_observed", "jira_feature_link_observed", "doc_section_observed", "mutation_score_observed", "user_journey_observed", "feature_candidate", "business_rule_candidate", "risk_candidate")
CANDIDATES = {"feature_candidate": "feature", "business_rule_candidate": "business_rule", "risk_candidate": "risk"}
PAGE_OWNERS = ("component", "api", "feature", "business_rule", "risk", "user_journey")
