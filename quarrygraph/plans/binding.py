"""The knowledge graph of the driver's tables: how each table stands for artifacts of a repository.

Regions, nations, suppliers and parts are components with dotted paths; orders are tests that cover their parts; a customer's months
are journeys over the parts ordered then; line items import parts into suppliers; part types, market segments and event types are
features, business rules and risks; pages are HTTP routes; days of events are compile runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph import schemas
from quarrygraph.functions import scalars as S
from quarrygraph.operators.durable import durable

REPO = "trade"


@dataclass
class Bound:
    spark: SparkSession
    sf_dir: str
    kept: dict = field(default_factory=dict)

    def once(self, name: str) -> DataFrame:
        """A table of this class, computed once and written, for queries that use it several times."""
        if name not in self.kept:
            self.kept[name] = durable(getattr(self, name))
        return self.kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def part_paths(self) -> DataFrame:
        return self.table("part").select("p_partkey", F.concat(F.lit("part.brand"), F.substring("p_brand", 7, 9), F.lit(".p"), F.col("p_partkey").cast("string")).alias("path"), "p_size")

    @cached_property
    def nation_paths(self) -> DataFrame:
        return self.table("nation").select("n_nationkey", F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string")).alias("path"))

    @cached_property
    def supplier_paths(self) -> DataFrame:
        joined = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(self.nation_paths, "n_nationkey")
        return joined.select("s_suppkey", F.concat("path", F.lit(".s"), F.col("s_suppkey").cast("string")).alias("path"))

    @cached_property
    def kill_rates(self) -> DataFrame:
        counts = self.table("lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("killed"), F.count_if(F.col("l_returnflag") == "A").alias("survived"), F.count_if(F.col("l_returnflag") == "N").alias("timeout"), F.count(F.lit(1)).alias("total"))
        return counts.select(F.col("l_partkey").alias("p_partkey"), "killed", "survived", "timeout", "total", S.kill_rate(F.col("killed"), F.col("total")).alias("kill_rate"))

    @cached_property
    def paths(self) -> DataFrame:
        """(path, kind, size, p_partkey): every component."""
        plain = lambda df, kind: df.select("path", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("p_partkey"))
        regions = self.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"))
        brands = self.table("part").select(F.concat(F.lit("part.brand"), F.substring("p_brand", 7, 9)).alias("path")).distinct()
        root = self.table("region").limit(1).select(F.lit("part").alias("path"))
        parts = self.part_paths.select("path", F.lit("module").alias("kind"), F.col("p_size").alias("size"), F.col("p_partkey").cast("long").alias("p_partkey"))
        return plain(regions, "package").unionByName(plain(self.nation_paths, "package")).unionByName(plain(self.supplier_paths, "module")).unionByName(plain(brands, "package")).unionByName(plain(root, "package")).unionByName(parts)

    @cached_property
    def components(self) -> DataFrame:
        """Parts of size 13 have only test files; a part last changed in run 3 + key % 5, other components in run 1."""
        rates = self.kill_rates.select("p_partkey", "kill_rate")
        file = F.when(F.col("size") == 13, F.concat(F.lit("tests/test_p"), F.col("p_partkey").cast("string"), F.lit(".py"))).otherwise(F.concat(F.replace("path", F.lit("."), F.lit("/")), F.lit(".py")))
        run = F.when(F.col("p_partkey").isNull(), 1).otherwise(F.col("p_partkey") % 5 + 3).cast("int")
        return self.paths.join(rates, "p_partkey", "left").select(F.lit(REPO).alias("repo_id"), S.entity_slug(F.lit("component"), F.col("path")).alias("slug"), "path", "kind", F.array(file).alias("files"), "kill_rate", run.alias("last_run"))

    @cached_property
    def tests(self) -> DataFrame:
        node = F.concat(F.lit("tests/test_o"), F.col("o_orderkey").cast("string"), F.lit(".py::test_it"))
        return self.table("orders").select(F.lit(REPO).alias("repo_id"), S.entity_slug(F.lit("test_coverage"), node).alias("slug"), node.alias("name"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("last_run"))

    @cached_property
    def targets(self) -> DataFrame:
        """(l_orderkey, p_partkey, path): distinct parts of the orders that exist."""
        lines = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
        return lines.join(self.table("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").join(self.part_paths.select("p_partkey", "path"), "p_partkey")

    @cached_property
    def covers(self) -> DataFrame:
        test = F.concat(F.lit("test-coverage/tests-test-o"), F.col("l_orderkey").cast("string"), F.lit("-py-test-it"))
        return self._edges(self.targets, "covers", test, S.entity_slug(F.lit("component"), F.col("path")))

    @cached_property
    def imports(self) -> DataFrame:
        return self.import_rows.distinct()

    @cached_property
    def import_names(self) -> DataFrame:
        return self.import_rows.select("repo_id", "name").distinct()

    @cached_property
    def import_rows(self) -> DataFrame:
        """(repo_id, from_path, name), with repeats: a supplier imports parts by a member of the part, without the root in line 1, and a foreign package in line 7."""
        lines = self.table("lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
        part = self.part_paths.select(F.col("p_partkey").alias("l_partkey"), F.col("path").alias("part"))
        supplier = self.supplier_paths.select(F.col("s_suppkey").alias("l_suppkey"), F.col("path").alias("from_path"))
        name = F.when(F.col("l_linenumber") == 1, F.substr("part", F.lit(6))).when(F.col("l_linenumber") == 7, F.concat(F.lit("lib.x"), (F.col("l_partkey") % 10).cast("string"))).otherwise(F.concat("part", F.lit(".v"), F.col("l_linenumber").cast("string")))
        return lines.join(part, "l_partkey").join(supplier, "l_suppkey").select(F.lit(REPO).alias("repo_id"), "from_path", name.alias("name"))

    @cached_property
    def links(self) -> DataFrame:
        """Features (part types) implemented by brands, rules (market segments) that govern nations, risks (event types) that affect regions."""
        component = lambda path: S.entity_slug(F.lit("component"), path)
        feature = self.table("part").select("p_type", "p_brand").distinct()
        rule = self.table("customer").select("c_mktsegment", F.col("c_nationkey").alias("n_nationkey")).distinct().join(self.nation_paths, "n_nationkey")
        risk = self.table("events").select("event_type", (F.col("user_id") % 5).alias("r")).distinct()
        a = self._edges(feature, "implemented_by", S.entity_slug(F.lit("feature"), F.col("p_type")), component(F.concat(F.lit("part.brand"), F.substring("p_brand", 7, 9))))
        b = self._edges(rule, "governs", S.entity_slug(F.lit("business_rule"), F.col("c_mktsegment")), component(F.col("path")))
        c = self._edges(risk, "affects", S.entity_slug(F.lit("risk"), F.col("event_type")), component(F.concat(F.lit("r"), F.col("r").cast("string"))))
        return a.unionByName(b).unionByName(c)

    @staticmethod
    def _edges(df: DataFrame, relation: str, start, end) -> DataFrame:
        return df.select(F.lit(REPO).alias("repo_id"), F.lit(relation).alias("relation_type"), start.alias("from_slug"), end.alias("to_slug"))

    @cached_property
    def steps(self) -> DataFrame:
        """(repo_id, journey, pos, step): every part that a customer ordered in a month, by order date and keys, each once."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        bought = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(orders, "l_orderkey")
        # Dealt by journey once, which serves the parts of a journey and their order.
        bought = bought.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")).repartition("o_custkey", "month")
        first = bought.groupBy("o_custkey", "month", "p_partkey").agg(F.min("o_orderdate").alias("day"), F.min_by("l_orderkey", F.struct("o_orderdate", "l_orderkey")).alias("l_orderkey"))
        placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey", "month").orderBy("day", "l_orderkey", "p_partkey")) - 1).join(self.part_paths.select("p_partkey", "path"), "p_partkey")
        name = F.concat(F.lit("user-journey/c"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("month"))
        return placed.select(F.lit(REPO).alias("repo_id"), name.alias("journey"), "pos", S.entity_slug(F.lit("component"), F.col("path")).alias("step"))

    def facts(self, rows: DataFrame, fact_type: str, payload) -> DataFrame:
        """Facts of a type from rows and a payload struct."""
        text = F.to_json(payload)
        return rows.select(F.lit(REPO).alias("repo_id"), F.lit(fact_type).alias("fact_type"), text.alias("payload"), F.array().cast("array<string>").alias("artifact_refs"), F.lit("bound").alias("extractor"), F.sha2(text, 256).alias("content_hash"), F.array().cast(f"array<{schemas.ANCHOR}>").alias("anchors"))

    @cached_property
    def component_facts(self) -> DataFrame:
        """Every path as an observed component with one function, and its imports."""
        comps = self.components.select("path", "kind", F.element_at("files", 1).alias("file"))
        seen = self.facts(comps, "component_observed", F.struct("path", "kind", F.lit("python").alias("language"), "file"))
        symbols = self.facts(comps, "symbol_observed", F.struct(F.concat("path", F.lit(".run")).alias("symbol_path"), F.lit("function").alias("kind")))
        deps = self.facts(self.imports, "dependency_observed", F.struct("from_path", F.col("name").alias("to_path")))
        return seen.unionByName(symbols).unionByName(deps)

    @cached_property
    def test_facts(self) -> DataFrame:
        """Every order as a file with one test, whose targets are the order's parts."""
        file = lambda key: F.concat(F.lit("tests/test_o"), key.cast("string"), F.lit(".py"))
        orders = self.table("orders").select(file(F.col("o_orderkey")).alias("file"))
        cases = self.facts(orders, "test_case_observed", F.struct(F.concat("file", F.lit("::test_it")).alias("node_id"), F.lit("pytest").alias("framework"), "file", F.col("file").alias("module")))
        parts = self.table("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(self.part_paths.select("p_partkey", "path"), "p_partkey").select(file(F.col("l_orderkey")).alias("test_module"), F.col("path").alias("target_path")).distinct()
        return cases.unionByName(self.facts(parts, "test_target_observed", F.struct("test_module", "target_path")))

    @cached_property
    def runs(self) -> DataFrame:
        """A run for every day of events; every third came from a pull request, every seventh failed."""
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
        days = self.table("events").select(day.alias("compile_run_id")).distinct()
        pr = F.when(F.col("compile_run_id") % 3 == 0, F.col("compile_run_id") + 100)
        return days.select(F.lit(REPO).alias("repo_id"), "compile_run_id", pr.cast("int").alias("pr_number"), F.concat(F.lit("sha"), F.col("compile_run_id").cast("string")).alias("commit_sha"), F.when(F.col("compile_run_id") % 7 == 0, "failed").otherwise("succeeded").alias("status"), F.lit(False).alias("degraded"))

    @cached_property
    def deltas(self) -> DataFrame:
        """One change for each run, user and kind of event."""
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
        op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "view", "moved").otherwise("changed")
        return self.table("events").select(F.lit(REPO).alias("repo_id"), day.alias("compile_run_id"), op.alias("op"), F.concat(F.lit("component/u"), F.col("user_id").cast("string")).alias("slug")).distinct()
