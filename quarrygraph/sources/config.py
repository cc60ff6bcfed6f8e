"""A repository's configuration, declared journeys and mutation scores."""

from __future__ import annotations

import json
import os
import tomllib


def read_config(folder: str, name: str = "kc.toml") -> dict:
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: initialise the repository first")
    with open(path, "rb") as f:
        return tomllib.load(f)


def write_config(folder: str, repo_slug: str, name: str = "kc.toml") -> bool:
    """A first configuration; False if there is one already."""
    path = os.path.join(folder, name)
    if os.path.exists(path):
        return False
    with open(path, "w") as f:
        f.write(f"[repo]\nslug = {json.dumps(repo_slug)}\n\n[dependencies]\n")
    return True


def journeys(config: dict, folder: str) -> list[tuple[str, list[str]]]:
    """(name, steps) declared in place, then those of the journey files; a file that is missing raises."""
    found = list(config.get("journeys") or [])
    listed = config.get("journeys_file") or []
    for name in [listed] if isinstance(listed, str) else listed:
        with open(os.path.join(folder, name), "rb") as f:
            found += tomllib.load(f).get("journeys") or []
    return [(j["name"], list(j.get("steps") or [])) for j in found]


def mutation_scores(folder: str, name: str = "mutation.json") -> list[tuple[str, int, int, int]]:
    """(module, killed, survived, timeout) by module; nothing without the file, 0 for a missing count."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        return []
    with open(path) as f:
        scores = json.load(f)
    return [(module, *(int(scores[module].get(k) or 0) for k in ("killed", "survived", "timeout"))) for module in sorted(scores)]


def declared_facts(repo_id: str, config: dict, folder: str) -> list[tuple[str, str, dict, list]]:
    """Journeys and scores as facts for compiler.extra_fact."""
    walks = [(repo_id, "user_journey_observed", {"name": n, "steps": s}, []) for n, s in journeys(config, folder)]
    return walks + [(repo_id, "mutation_score_observed", {"module": m, "killed": k, "survived": s, "timeout": t}, []) for m, k, s, t in mutation_scores(folder)]


def dependencies(config: dict) -> list[tuple[int, str, str]]:
    """(position, coordinate, repository) in the order of their declaration."""
    return [(i, key, slug) for i, (key, slug) in enumerate((config.get("dependencies") or {}).items())]
