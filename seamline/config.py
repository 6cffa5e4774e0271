"""A project's configuration: YAML or JSON, checked and clamped; unknown keys are left alone."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field

NAMES = [".repolens.yml", ".repolens.yaml", ".repolens.json"]


@dataclass(frozen=True)
class Classification:
    owned_prefixes: tuple[str, ...] = ()
    team_prefixes: tuple[str, ...] = ()
    company_prefixes: tuple[str, ...] = ()
    third_party_packages: tuple[str, ...] = ()
    show_packages: tuple[str, ...] = ()
    hide_packages: tuple[str, ...] = ()


@dataclass(frozen=True)
class ProjectConfig:
    languages: tuple[str, ...] = ("python", "javascript")
    ignore: tuple[str, ...] = ()
    suppressions: tuple[tuple[str, str], ...] = ()
    severity: tuple[tuple[str, str], ...] = ()
    tests_lower: bool = True
    node_budget: int = 0
    edge_contrast: int = 60
    ttl_seconds: int = 300
    classification: Classification = field(default_factory=Classification)

    def fingerprint(self) -> str:
        """Twelve hex digits that change with any setting."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]


def unique(values: list | tuple | None) -> tuple[str, ...]:
    """Non-empty strings, each once whatever its case, in order."""
    seen: dict[str, str] = {}
    for value in values or ():
        text = str(value).strip()
        if text:
            seen.setdefault(text.lower(), text)
    return tuple(seen.values())


def _number(value, default: int, low: int, high: int | None = None) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return max(low, number if high is None else min(high, number))


def parse(raw: dict | None) -> ProjectConfig:
    raw = raw if isinstance(raw, dict) else {}
    part = lambda name: raw.get(name) if isinstance(raw.get(name), dict) else {}
    rules, ui, cache, classes = part("rules"), part("ui"), part("cache"), part("classification")
    default = ProjectConfig()
    return ProjectConfig(
        languages=tuple(x.lower() for x in unique(raw.get("languages"))) or default.languages,
        ignore=unique(raw.get("ignore")),
        suppressions=tuple((str(s.get("rule", "*")), str(s.get("path", "*"))) for s in rules.get("suppressions") or () if isinstance(s, dict)),
        severity=tuple(sorted((str(k), str(v).lower()) for k, v in (rules.get("severity") or {}).items())),
        tests_lower=bool(rules.get("tests_lower", True)),
        node_budget=_number(ui.get("node_budget"), default.node_budget, 0),
        edge_contrast=_number(ui.get("edge_contrast"), default.edge_contrast, 25, 100),
        ttl_seconds=_number(cache.get("ttl_seconds"), default.ttl_seconds, 0),
        classification=Classification(**{k: unique(classes.get(k)) for k in asdict(default.classification)}),
    )


def read(root: str) -> tuple[str, dict]:
    """The path of a folder's configuration file (the first name where there is none) and what it holds."""
    path = next((p for name in NAMES if os.path.exists(p := os.path.join(root, name))), os.path.join(root, NAMES[0]))
    if not os.path.exists(path):
        return path, {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        found = json.loads(text or "{}")
    else:
        import yaml

        found = yaml.safe_load(text)
    return path, found if isinstance(found, dict) else {}


def write(path: str, raw: dict) -> None:
    """Writes a configuration file as a whole; keys keep their order."""
    if path.endswith(".json"):
        text = json.dumps(raw, indent=2) + "\n"
    else:
        import yaml

        text = yaml.safe_dump(raw, sort_keys=False, allow_unicode=True)
    attempt = f"{path}.attempt"
    with open(attempt, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(attempt, path)


#: The list that each category's packages go to.
CATEGORY_LISTS = {"owned": "owned_prefixes", "team": "show_packages", "third_party": "third_party_packages", "hide": "hide_packages", "docs_config": "hide_packages"}


def classified(raw: dict, package: str, category: str) -> dict:
    """A configuration in which the package is in the category's list and, whatever its case, in no other."""
    name, kind = package.strip(), category.strip().lower().replace("-", "_")
    if not name:
        raise ValueError("a package name is required")
    if kind not in CATEGORY_LISTS:
        raise ValueError(f"no such category: {category}")
    old = raw.get("classification") if isinstance(raw.get("classification"), dict) else {}
    lists = {k: [x for x in unique(old.get(k)) if x.lower() != name.lower()] for k in asdict(Classification())}
    lists[CATEGORY_LISTS[kind]].append(name)
    return raw | {"classification": lists}


def classify(root: str, package: str, category: str) -> ProjectConfig:
    """Puts a package into a category, in the folder's configuration file."""
    path, raw = read(root)
    write(path, classified(raw, package, category))
    return load(root)


def restore_classification(root: str, lists: dict) -> ProjectConfig:
    """Replaces all lists of the classification."""
    path, raw = read(root)
    write(path, raw | {"classification": {k: list(unique(lists.get(k))) for k in asdict(Classification())}})
    return load(root)


def load(root: str) -> ProjectConfig:
    """The first configuration file of a folder, or the defaults."""
    return parse(read(root)[1])
