"""Merged pull requests and direct commits: from a hosting service, or given rows with the same behaviour."""

from __future__ import annotations

import datetime
import itertools
import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import schemas

PAGE = 100
#: Kinds of change of the service by the graph's names (fixed values of the service).
CHANGES = {"added": "added", "modified": "modified", "removed": "removed", "renamed": "renamed", "copied": "added", "changed": "modified"}


def _time(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(datetime.timezone.utc).replace(tzinfo=None)


@dataclass
class RestForge:
    """Reader of a REST service in the style of the large code hosts; the token comes from an environment variable."""

    api: str
    repo: str
    token_variable: str = "FORGE_TOKEN"
    opener: object = field(default=None)

    def get(self, path: str):
        token = os.environ.get(self.token_variable)
        if not token:
            raise RuntimeError(f"{self.token_variable} is not set")
        request = urllib.request.Request(f"{self.api}/{path}", headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
        try:
            with (self.opener or urllib.request.urlopen)(request) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code == 404:
                raise LookupError(f"{path} was not found: does {self.repo} exist, and may the token read it?") from error
            raise

    def pages(self, path: str, key: str | None = None):
        """Every item of a listing, page by page until one is not full; what the service itself cuts short raises when it says so."""
        joint = "&" if "?" in path else "?"
        for page in itertools.count(1):
            answer = self.get(f"{path}{joint}per_page={PAGE}&page={page}")
            listed = answer if key is None else answer.get(key, [])
            yield from listed
            if len(listed) < PAGE:
                return

    def merged_prs(self, spark: SparkSession, branch: str, since: datetime.datetime | None) -> DataFrame:
        rows = []
        for pr in self.pages(f"repos/{self.repo}/pulls?state=closed&base={branch}&sort=updated&direction=desc"):
            if since is not None and pr.get("updated_at") and _time(pr["updated_at"]) <= since:
                break  # the rest was last touched before, so it was merged before
            if pr.get("merged_at") and (since is None or _time(pr["merged_at"]) > since):
                files = [(f["filename"], CHANGES.get(f["status"], f["status"]), f.get("previous_filename")) for f in self.pages(f"repos/{self.repo}/pulls/{pr['number']}/files")]
                rows.append((pr["number"], pr.get("title"), pr.get("body"), _time(pr["merged_at"]), pr.get("merge_commit_sha"), files))
        return spark.createDataFrame(sorted(rows, key=lambda r: (r[3], r[0])), schemas.MERGED_PRS)

    def one_pr(self, spark: SparkSession, number: int) -> DataFrame:
        """A merged pull request by its number; one that isn't merged raises."""
        pr = self.get(f"repos/{self.repo}/pulls/{number}")
        if not pr.get("merged_at"):
            raise LookupError(f"pull request {number} is not merged")
        files = [(f["filename"], CHANGES.get(f["status"], f["status"]), f.get("previous_filename")) for f in self.pages(f"repos/{self.repo}/pulls/{number}/files")]
        return spark.createDataFrame([(number, pr.get("title"), pr.get("body"), _time(pr["merged_at"]), pr.get("merge_commit_sha"), files)], schemas.MERGED_PRS)

    def commits(self, spark: SparkSession, branch: str, since: datetime.datetime | None) -> DataFrame:
        rows, after = [], f"&since={since.isoformat()}Z" if since else ""
        for c in self.pages(f"repos/{self.repo}/commits?sha={branch}{after}"):
            first = self.get(f"repos/{self.repo}/commits/{c['sha']}")
            files = self.pages(f"repos/{self.repo}/commits/{c['sha']}", "files") if len(first.get("files", [])) >= PAGE else first.get("files", [])
            rows.append((c["sha"], _time(first["commit"]["committer"]["date"]), first["commit"]["message"], [f["filename"] for f in files if f["status"] != "removed"]))
        return spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), schemas.COMMITS)


def since(rows: DataFrame, column: str, moment) -> DataFrame:
    """Rows strictly after a moment, which is how given rows behave like a service."""
    return rows if moment is None else rows.where(F.col(column) > F.lit(moment))
