"""What paths, commit subjects and graph parts imply, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabularies and the texts they stand for.
ARCHITECTURE_TERMS = ["api", "architecture", "auth", "authentication", "authorization", "cache", "database", "docker", "gateway", "jwt", "kafka", "kubernetes", "migration", "microservice", "postgres", "queue", "redis", "retry", "service", "terraform"]
PURPOSES = {"add": "Added", "added": "Added", "introduce": "Introduced", "introduced": "Introduced", "fix": "Fixed", "fixed": "Fixed", "refactor": "Refactored", "remove": "Removed", "removed": "Removed", "update": "Updated", "updated": "Updated", "migrate": "Migrated", "migrated": "Migrated"}
MOTIVATIONS = {
    "timeout": "Likely response to timeout or reliability failures.",
    "retry": "Likely added to improve resilience after transient failures.",
    "bug": "Likely motivated by a reported defect.",
    "fix": "Likely motivated by incorrect behavior or failing tests.",
    "security": "Likely motivated by security hardening.",
    "auth": "Likely related to authentication or authorization behavior.",
    "performance": "Likely motivated by latency or efficiency concerns.",
    "cache": "Likely motivated by repeated work, latency, or load reduction.",
    "migration": "Likely part of a platform or data model migration.",
}
NO_MOTIVATION = "Motivation not explicit in indexed evidence."
HIGH_RISK = ["auth", "security", "payment", "migration", "database", "schema", "infra"]
MEDIUM_RISK = ["retry", "cache", "api", "service"]
HIGH_IMPACT = ["microservice", "kafka", "redis", "database", "terraform", "kubernetes", "migration"]
MEDIUM_IMPACT = ["cache", "queue", "api", "gateway", "service", "architecture", "jwt", "auth"]
SENSITIVE = ["auth", "payment", "database", "migration", "security"]
PLAIN_WORDS = ["readme", "docs", "test", "tests", "file", "files", "code", "update"]
INTENTS = [
    ("test", ["test", "spec", "coverage", "validate", "assert"]),
    ("bug", ["bug", "fix", "error", "exception", "fail", "regression"]),
    ("ownership", ["owner", "owns", "authored", "maintainer", "who changed"]),
    ("architecture", ["architecture", "design", "decision", "adr", "why"]),
    ("api", ["api", "request", "route", "endpoint", "flow"]),
    ("data", ["data", "database", "db", "sql", "model", "schema"]),
]
ENTRYPOINTS = ["main", "handler", "route_", "describe_", "it_", "test_", "setup", "teardown"]
SOURCE_ROOTS = ["src", "app", "lib", "services"]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-case text holds one of the words, anywhere."""
    return F.lower(text).rlike("|".join(words))


def component(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.coalesce(F.when(first.isin(SOURCE_ROOTS) & second.isNotNull(), second).otherwise(first), F.lit("root"))


def module_name(path: Column) -> Column:
    plain = F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(plain, r"\.__init__$", "")


def purpose(subject: Column) -> Column:
    clean = F.trim(subject)
    verb = F.element_at(F.create_map(*[F.lit(x) for pair in PURPOSES.items() for x in pair]), F.lower(F.regexp_extract(clean, r"^(\S+)", 1)))
    rest = F.regexp_extract(clean, r"^\S+\s+(.*)$", 1)
    return F.when(verb.isNotNull(), F.concat(verb, F.lit(" "), F.when(rest != "", rest).otherwise(clean))).when(clean != "", clean).otherwise("Repository change")


def motivation(subject: Column) -> Column:
    found = F.lit(NO_MOTIVATION)
    for word, reason in reversed(MOTIVATIONS.items()):
        found = F.when(F.lower(subject).contains(word), reason).otherwise(found)
    return found


def _subject_and_files(subject: Column, files: Column) -> Column:
    return F.lower(F.concat_ws(" ", subject, F.array_join(files, " ")))


def risk_level(subject: Column, files: Column) -> Column:
    text, many = _subject_and_files(subject, files), F.size(files)
    return F.when(has_any(text, HIGH_RISK) | (many >= 12), "high").when((many >= 5) | has_any(text, MEDIUM_RISK), "medium").otherwise("low")


def architectural_impact(subject: Column, files: Column) -> Column:
    text = _subject_and_files(subject, files)
    return F.when(has_any(text, HIGH_IMPACT), "high").when(has_any(text, MEDIUM_IMPACT), "medium").otherwise("low")


def is_introductory(subject: Column) -> Column:
    return F.lower(subject).rlike("^(add|added|introduce|introduced) ")


def pull_request(subject: Column) -> Column:
    parts = [F.nullif(F.regexp_extract(subject, p, 1), F.lit("")) for p in (r"\(#(\d+)\)", r"(?i)pull request #?(\d+)", r"(?i)pr #?(\d+)")]
    return F.coalesce(*parts).cast("int")


def feature_terms(text: Column) -> Column:
    """Architecture words anywhere in the text, and longer words that end like actions; sorted, each once."""
    known = lambda low: F.filter(F.array(*map(F.lit, ARCHITECTURE_TERMS)), lambda t: F.contains(low, t))
    words = lambda low: F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z][a-z0-9_]{3,})"), F.lit(1)))
    found = lambda low: F.filter(words(low), lambda w: (w.endswith("ing") | w.endswith("tion") | w.isin(ARCHITECTURE_TERMS)) & ~w.isin(PLAIN_WORDS))
    terms = lambda low: F.sort_array(F.array_union(known(low), F.transform(found(low), lambda w: F.replace(w, F.lit("_"), F.lit(" ")))))
    # the text is lower-cased once: a lambda's variable holds it, where a column would be computed anew for each term
    return F.get(F.transform(F.array(F.lower(text)), terms), F.lit(0))


def document_kind(path: Column) -> Column:
    return F.when(has_any(path, ["adr"]), "decision").when(has_any(path, ["release", "changelog"]), "release").when(has_any(path, ["incident", "postmortem"]), "incident").otherwise("event")


def commit_snippet(subject: Column, files: Column, components: Column) -> Column:
    listed = F.concat(F.array_join(F.slice(files, 1, 6), ", "), F.when(F.size(files) > 6, F.concat(F.lit(", and "), (F.size(files) - 6).cast("string"), F.lit(" more"))).otherwise(""))
    where = F.when(F.size(components) > 0, F.array_join(components, ", ")).otherwise("unknown components")
    return F.concat(F.lit("Purpose: "), purpose(subject), F.lit(". Motivation: "), motivation(subject), F.lit(" Impacted components: "), where, F.lit(". Risk: "), risk_level(subject, files), F.lit(". Changed files: "), listed, F.lit("."))


def intent(query: Column) -> Column:
    found = F.lit("general")
    for name, words in reversed(INTENTS):
        found = F.when(has_any(query, words), name).otherwise(found)
    return found


def is_entrypoint(name: Column, path: Column) -> Column:
    return name.startswith("_") | has_any(name, ENTRYPOINTS) | F.lower(path).rlike("(^|/)(tests?|spec|migrations?)/")


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def is_test_for_ranking(path: Column) -> Column:
    return has_any(path, ["test", "spec"])


def is_test_for_rules(path: Column) -> Column:
    return F.lower(path).rlike("/tests?/") | _base(path).startswith("test_") | _base(path).contains(".test.")


def is_test_for_verification(path: Column) -> Column:
    return is_test_for_rules(path) | _base(path).endswith("_test.py") | _base(path).contains(".spec.")


def is_document(path: Column) -> Column:
    return F.lower(path).startswith("docs/") | has_any(path, ["readme", "adr", "design", "architecture", "rfcs"])


def component_risk(commits: Column, authors: Column, files: Column, is_service: Column) -> Column:
    return F.when((commits >= 25) | (authors >= 8) | is_service, "high").when((commits >= 8) | (files >= 8), "medium").otherwise("low")


#: Names, patterns and prefixes of node categories.
COMMON_NAMES = [
    ".gitignore", "__init__.py", "abc", "argparse", "ast", "asyncio", "collections", "configparser", "copy", "dataclasses", "datetime", "dateutil", "docutils", "docs", "enum", "functools", "hashlib", "http", "importlib",
    "inspect", "io", "itertools", "json", "logging", "math", "mcp", "mock", "networkx", "numpy", "object", "operator", "os", "pandas", "pathlib", "pbr", "pkgutil", "pyproject.toml", "pytest", "re", "readme.md", "requests",
    "rich", "rst", "setuptools", "shutil", "socket", "sphinx", "sqlalchemy", "sqlite3", "subprocess", "sys", "tempfile", "textwrap", "threading", "time", "tree_sitter", "tree_sitter_language_pack", "typer", "typing",
    "unittest", "urllib", "uuid", "watchdog", "webbrowser", "yaml",
]
COMMON_STEMS = ["docs?", "api[-_]?guide", "api[-_]?ref", "release[-_]?notes?", "requirements?", "test[-_]?requirements?", "setup", "tox", "bindep", "mypy", "hacking", "readme", "agents"]
COMMON_ENDINGS = r"\.(cfg|conf|coveragerc|ini|md|rst|toml|txt|ya?ml)$"
TEAM_PREFIXES = ["oslo_", "oslo.", "openstack", "keystone", "nova", "neutron", "glance", "cinder", "swift", "tempest", "ironic", "manila", "horizon", "ceilometer"]


def _listed(ident: Column, label: Column, packages: list[str]) -> Column:
    clean = [p.strip().lower() for p in packages if p and p.strip()]
    return reduce(lambda a, p: a | ident.eqNullSafe(p) | label.eqNullSafe(p) | ident.startswith(p + ".") | label.startswith(p + "."), clean, F.lit(False))


def _prefixed(ident: Column, label: Column, prefixes: list[str]) -> Column:
    clean = [p.strip().lower() for p in prefixes if p and p.strip()]
    return reduce(lambda a, p: a | ident.startswith(p) | label.startswith(p), clean, F.lit(False))


def node_category(ident: Column, label: Column, path: Column, kind: Column, tags: Column, *, owned: list[str] = (), third_party: list[str] = (), shown: list[str] = (), hidden: list[str] = (), team: list[str] = ()) -> Column:
    """owned, team, third_party, docs_config, tests or generated; configured names decide before patterns."""
    ident = F.lower(F.regexp_replace(F.coalesce(ident, F.lit("")), "^component:", ""))
    label, path = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    text = F.concat_ws(" ", F.nullif(ident, F.lit("")), F.nullif(label, F.lit("")), F.nullif(path, F.lit("")))
    stems = "|".join(rf"(^|[._-]){s}($|[._-])" for s in COMMON_STEMS) + "|" + COMMON_ENDINGS
    docs = _listed(ident, label, hidden) | ident.isin(COMMON_NAMES) | label.isin(COMMON_NAMES) | ident.rlike(stems) | label.rlike(stems)
    external = kind.eqNullSafe("external") | F.coalesce(F.array_contains(tags, "external"), F.lit(False))
    ours = _listed(ident, label, shown) | (~_listed(ident, label, hidden) & _prefixed(ident, label, [*TEAM_PREFIXES, *owned, *team]))
    return (
        F.when(_listed(ident, label, owned) | _prefixed(ident, label, owned), "owned")
        .when(_listed(ident, label, third_party), "third_party")
        .when(_listed(ident, label, shown), "team")
        .when(text.rlike(r"(^|[/._-])(generated|dist|build|coverage|node_modules|vendor)($|[/._-])"), "generated")
        .when(docs, "docs_config")
        .when(kind.eqNullSafe("test") | text.rlike(r"(^|[/._-])(__tests__|tests?|specs?)($|[/._-])"), "tests")
        .when(external, F.when(ours, "team").otherwise("third_party"))
        .otherwise("owned")
    )


#: Connection categories of edge types.
CONNECTIONS = {"api_call": "api", "calls": "functions", "function_call": "functions", "graphql": "graphql", "database": "database", "test_covers": "tests", "cochange": "git", "authored": "git", "touched": "git", "custom": "custom"}


def connection(edge_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CONNECTIONS.items() for x in pair]), F.lower(edge_type)), F.lit("component"))


def connections(edge_type: Column, source_category: Column, target_category: Column) -> Column:
    """An edge's connection categories, with `projects` where it leaves the repository."""
    outside = source_category.isin("team", "third_party") | target_category.isin("team", "third_party")
    return F.when(outside, F.array(connection(edge_type), F.lit("projects"))).otherwise(F.array(connection(edge_type)))


def edge_confidence(edge_type: Column, weight: Column, examples: Column, reasons: Column) -> Column:
    """5 to 96, from the numbers of examples and reasons, the weight and the type."""
    score = F.lit(10.0) + F.when(examples > 0, F.least(F.lit(55), 25 + examples * 6)).otherwise(0) + F.when(reasons > 0, F.least(F.lit(20), reasons * 4)).otherwise(0)
    score = score + F.least(F.lit(15.0), F.log2(F.greatest(weight, F.lit(1.0)) + 1) * 5)
    score = score + F.when(F.lower(edge_type).isin("calls", "references", "imports", "inherits"), 10).when(F.lower(edge_type) == "cochange", 5).otherwise(0)
    score = F.when((examples == 0) & (reasons == 0), F.least(score, F.lit(30.0))).otherwise(score)
    return F.floor(F.greatest(F.lit(5.0), F.least(F.lit(96.0), score)) + 0.5).cast("int")


def confidence_label(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 60, "good").when(score >= 35, "partial").otherwise("sparse")


def impact_risk(status: Column, path: Column, owners: Column, related: Column, evidence: Column) -> tuple[Column, Column]:
    """Risk and reasons of a changed file; owners, related and evidence are numbers."""
    kind = F.substring(status, 1, 1)
    sensitive = has_any(path, SENSITIVE)
    score = (
        F.when(kind == "D", 3).when(kind == "R", 2).when(kind == "A", 1).otherwise(0)
        + F.when(sensitive, 4).otherwise(0)
        + F.when(owners > 0, 1).otherwise(2)
        + F.least(F.lit(3), related)
        + F.when(evidence > 0, 1).otherwise(0)
    )
    reasons = F.array_compact(
        F.array(
            F.when(kind == "D", "file deleted").when(kind == "R", "file renamed").when(kind == "A", "new file"),
            F.when(sensitive, "sensitive component name"),
            F.when(owners > 0, "historical owners found").otherwise("no historical owner found"),
            F.when(related > 0, "co-change neighbors found"),
            F.when(evidence > 0, "historical evidence found"),
        )
    )
    return F.when(score >= 6, "high").when(score >= 4, "medium").otherwise("low"), reasons
