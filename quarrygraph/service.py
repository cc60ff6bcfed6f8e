"""The twelve read-only questions over a store, one method each; they never compile or write the graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions import scalars as S
from quarrygraph.operators import search, serve, wiki
from quarrygraph.operators.durable import durable
from quarrygraph.operators.store import Store


@dataclass
class Graph:
    """The last version of one repository's graph. dependencies are (position, coordinate, repository) of its configuration; vectors is the embeddings table."""

    store: Store
    repo_id: str
    dependencies: list[tuple[int, str, str]] = field(default_factory=list)
    vectors: DataFrame | None = None
    embedder: object = None

    def check(self) -> None:
        if self.repo_id not in self.store.repositories():
            raise LookupError(f"repository {self.repo_id!r} is not in this store: initialise and compile it first")

    def _table(self, name: str) -> DataFrame:
        self.check()
        return self.store.read(name).where(F.col("repo_id") == self.repo_id)

    @property
    def entities(self) -> DataFrame:
        return self._table("entities")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def components(self) -> DataFrame:
        rate = F.get_json_object("payload", "$.mutation_kill_rate").cast("double")
        return self.entities.where("entity_type = 'component'").select("repo_id", "slug", F.col("name").alias("path"), "files", rate.alias("kill_rate"), "last_run", "payload")

    @property
    def tests(self) -> DataFrame:
        return self.entities.where("entity_type = 'test_coverage'").select("repo_id", "slug", "last_run")

    @property
    def steps(self) -> DataFrame:
        listed = F.from_json(F.get_json_object("payload", "$.steps"), "array<string>")
        return self.entities.where("entity_type = 'user_journey'").select("repo_id", F.col("slug").alias("journey"), F.explode(listed).alias("step"))

    def search_knowledge(self, query: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
        """(slug, entity_type, name, score, payload): keyword and vector search fused, keyword alone without current vectors."""
        shown = self.entities.where("entity_type <> 'wiki_page'")
        shown = shown if entity_type is None else shown.where(F.col("entity_type") == entity_type)
        body = F.concat_ws(" ", "name", F.replace("name", F.lit("."), F.lit(" ")), "payload")
        docs = shown.select(F.col("slug").alias("key"), body.alias("body"))
        near, one = None, None
        if self.vectors is not None and self.embedder is not None:
            current = self.vectors.where((F.col("status") == "current") & (F.col("model_id") == self.embedder.model_id)).join(shown.select("repo_id", "slug"), ["repo_id", "slug"], "left_semi")
            near = current.select(F.col("slug").alias("key"), "vector")
            one = self.store.spark.createDataFrame([(self.embedder.embed([query])[0],)], "vector array<double>")
        found = search.hybrid(docs, near, query, one, limit).withColumnRenamed("key", "slug")
        return found.join(shown.select("slug", "entity_type", "name", "payload"), "slug").orderBy(F.col("score").desc(), "slug")

    def get_entity(self, slug: str) -> DataFrame:
        """One row, or none; a component also has the repositories behind its external dependencies."""
        one = serve.get_entity(self.entities, self.edges, self._table("provenance"), slug)
        external = F.explode(F.from_json(F.get_json_object("payload", "$.external_dependencies"), "array<string>"))
        named = self.entities.where(F.col("slug") == slug).select(external.alias("coord"))
        resolved = self._resolved(named).agg(F.array_sort(F.collect_list(F.struct("coord", "repo_slug"))))
        return one.withColumn("cross_repo_dependencies", resolved.scalar())

    def list_entities(self, entity_type: str, limit: int = 200) -> DataFrame:
        return serve.list_entities(self.entities, entity_type, limit)

    def recent_changes(self, newest: int = 10) -> DataFrame:
        return serve.recent_changes(self._table("runs"), self._table("deltas"), newest)

    def which_pr_introduced(self, slug: str) -> DataFrame:
        runs = self._table("runs").withColumnRenamed("sha", "commit_sha")
        return serve.introduced_by(self._table("deltas").where(F.col("slug") == slug), runs)

    def linked_context(self, component: str) -> DataFrame:
        """One row; empty lists for a component that isn't known."""
        asked = self.store.spark.createDataFrame([(self.repo_id, component)], "repo_id string, slug string")
        return serve.linked_context(asked, self.edges)

    def coverage(self) -> DataFrame:
        return serve.coverage(self.components, self.edges, self.tests)

    def coverage_for(self, component: str) -> DataFrame:
        return self.coverage().where(F.col("slug") == component)

    def _targets(self, slug: str, covered: DataFrame) -> DataFrame:
        return serve.impact_targets(self.entities, self.edges, self.components, covered).where(F.col("slug") == slug)

    def impact_plan(self, slug: str) -> DataFrame:
        """(relation, affected, verdict): what would need another look; verdict is set for components that are not tests."""
        near = serve.impact(self.entities, self.edges).where(F.col("slug") == slug).select("relation", "affected")
        own = self.components.where(F.col("slug") == slug).select(F.lit("self").alias("relation"), F.col("slug").alias("affected"))
        verdicts = self._targets(slug, self.coverage()).select(F.col("target").alias("affected"), "verdict")
        return near.unionByName(own).join(verdicts, "affected", "left").select("relation", "affected", "verdict").orderBy("relation", "affected")

    def journey_coverage(self, slug: str | None = None) -> DataFrame:
        needed = serve.step_components(self.steps, self.edges, self.entities)
        journeys = self.entities.where("entity_type = 'user_journey'").select("repo_id", F.col("slug").alias("journey"))
        found = serve.journey_coverage(journeys, needed, self.edges)
        return found if slug is None else found.where(F.col("journey") == slug)

    def test_plan(self, slug: str) -> DataFrame:
        """Recommendations in the order of their kinds: gaps, stale tests, weak tests, journeys."""
        covered = durable(self.coverage())
        listed = F.explode(F.from_json(F.get_json_object("payload", "$.symbols"), "array<struct<symbol_path:string,kind:string>>"))
        symbols = self.components.select("repo_id", "slug", listed.alias("s")).select("repo_id", "slug", "s.symbol_path", "s.kind")
        plan = serve.test_plan(durable(self._targets(slug, covered)), covered, self.edges, symbols, self.journey_coverage(), self.steps)
        return plan.where(F.col("slug") == slug).orderBy("ordinal", "component", "target")

    def _resolved(self, coordinates: DataFrame) -> DataFrame:
        declared = self.store.spark.createDataFrame(self.dependencies, "position int, key string, repo_slug string")
        return serve.resolve_dependency(coordinates, declared)

    def resolve_dependency(self, coordinate: str) -> DataFrame:
        """(coord, repo_slug, entity_counts): the repository behind a coordinate and what this store knows of it; no row if none is declared."""
        found = self._resolved(self.store.spark.createDataFrame([(coordinate,)], "coord string"))
        counts = self.store.read("entities").groupBy(F.col("repo_id").alias("repo_slug"), "entity_type").agg(F.count(F.lit(1)).alias("n")).groupBy("repo_slug").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_counts"))
        return found.join(counts, "repo_slug", "left").select("coord", "repo_slug", "entity_counts")

    def knowledge_stats(self) -> DataFrame:
        return serve.stats(self.entities, self.edges, self._table("runs").withColumnRenamed("sha", "commit_sha"))

    def emit(self, folder: str, dirty: DataFrame | None = None) -> list[str]:
        """Write pages, index and log below a folder; without dirty slugs all pages. What fails is reported, for the graph is committed already."""
        warnings = []
        for step in (
            lambda: wiki.emit(wiki.pages(self.entities, self.edges, self._table("deltas"), dirty), folder),
            lambda: wiki.emit(wiki.summary_pages(self.entities, self._table("deltas"), self._table("runs")), folder),
            lambda: wiki.prune(self.store.spark, self.entities, folder),
        ):
            try:
                step()
            except Exception as error:  # pages can be written again at any time
                warnings.append(str(error)[:500])
        return warnings
