"""Publishing a folder of pages as the whole content of a branch, without touching the working tree, the index or the checked-out branch."""

from __future__ import annotations

import os
import subprocess
import time
from dataclasses import dataclass

NAME, MAIL = "quarrygraph", "quarrygraph@localhost"


@dataclass(frozen=True)
class Branch:
    """A branch that belongs to the publisher: every publication is a commit of all pages, and nothing else is in it."""

    repo: str
    branch: str = "knowledge/wiki"
    remote: str = "origin"
    push: bool = True

    def _git(self, *words: str, given: bytes | None = None) -> str:
        done = subprocess.run(["git", "-C", self.repo, *words], input=given, capture_output=True)
        if done.returncode:
            raise RuntimeError(f"git {words[0]}: {done.stderr.decode(errors='replace').strip()}")
        return done.stdout.decode().strip()

    def _known(self, name: str) -> str | None:
        try:
            return self._git("rev-parse", "--verify", "--quiet", name)
        except RuntimeError:
            return None

    def publish(self, folder: str, message: str) -> str | None:
        """The new commit, or None where the branch shows the same pages already. Files go through one fast-import stream to a ref of its own, which the branch then follows."""
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        ref, staged = f"refs/heads/{self.branch}", f"refs/quarrygraph/{self.branch}"
        before = self._known(ref)
        note = f"{message} [skip ci]".encode()
        now = self._git("log", "-1", "--format=%ct", before) if before else "0"
        lines = [f"commit {staged}\ncommitter {NAME} <{MAIL}> {max(int(time.time()), int(now))} +0000\ndata {len(note)}\n".encode() + note + b"\n"]
        lines += [f"from {before}\n".encode()] if before else []
        lines.append(b"deleteall\n")
        for where, folders, names in os.walk(folder):
            folders.sort()
            for name in sorted(names):
                full = os.path.join(where, name)
                with open(full, "rb") as f:
                    body = f.read()
                path = os.path.relpath(full, folder).replace(os.sep, "/").replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                lines.append(f'M 100644 inline "{path}"\ndata {len(body)}\n'.encode() + body + b"\n")
        try:
            self._git("fast-import", "--quiet", "--force", given=b"".join(lines))
            made = self._known(staged)
            same = before is not None and self._git("rev-parse", f"{before}^{{tree}}") == self._git("rev-parse", f"{made}^{{tree}}")
            if not same:
                self._git("update-ref", ref, made, *([before] if before else []))
        finally:
            if self._known(staged):
                self._git("update-ref", "-d", staged)
        if self.push:
            self._git("push", "--quiet", *([] if same else ["--force"]), self.remote, ref)
        return None if same else made
