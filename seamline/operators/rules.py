"""Static rules over lines, with suppression and configured severities."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as tx


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    languages: tuple[str, ...]
    pattern: str
    unless: str | None = None
    confidence: float = 0.74
    #: Lower-case texts of which every line that the pattern finds holds one: looked for before the pattern is tried.
    hints: tuple[str, ...] = ()


#: The rules' patterns.
RULES = [
    Rule("possible-secret", "high", ("python", "javascript"), r"(?i)\b([A-Za-z0-9_]*(?:api[_-]?key|secret|token|password)[A-Za-z0-9_]*)\b\s*[:=]\s*['\"]([^'\"]{8,})['\"]", confidence=0.82, hints=("api", "secret", "token", "password")),
    Rule("python-requests-without-timeout", "medium", ("python",), r"\brequests\.(get|post|put|patch|delete|request)\s*\(", r"timeout\s*=", hints=("requests.",)),
    Rule("shell-true", "high", ("python",), r"\bsubprocess\.[A-Za-z_]+\([^#\n]*shell\s*=\s*True", hints=("subprocess.",)),
    Rule("dynamic-code-execution", "high", ("python", "javascript"), r"\b(eval|exec)\s*\(", hints=("eval", "exec")),
    Rule("sql-string-interpolation", "high", ("python", "javascript"), r"\bexecute(?:Query)?\s*\(\s*(?:f['\"]|`|\w+\s*\+)", hints=("execute",)),
    Rule("fetch-without-abort", "low", ("javascript",), r"\bfetch\s*\(", r"signal", hints=("fetch",)),
]
HARMLESS_VALUES = ["change_password", "updating_password", "admin_password", "fake_password", "fake_token", "test_password"]
TEST_VALUES = ["fake", "dummy", "test", "password", "token", "secret"]


@dataclass(frozen=True)
class RuleConfig:
    suppressions: list[dict[str, str]] = field(default_factory=list)
    severity: dict[str, str] = field(default_factory=dict)
    tests_lower: bool = True


def glob(path: Column, pattern: str) -> Column:
    """Whether a glob, whose * crosses slashes, fits the whole path or its last part."""
    form = fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")
    return path.rlike("^" + form) | F.element_at(F.split(path, "/"), -1).rlike("^" + form)


def _harmless(line: Column, path: Column, rule: Rule) -> Column:
    name, value = F.lower(F.regexp_extract(line, rule.pattern, 1)), F.trim(F.regexp_extract(line, rule.pattern, 2))
    low = F.lower(value)
    return value.rlike("^[A-Z][A-Z0-9_]{7,}$") | low.isin(HARMLESS_VALUES) | (F.contains(name, low) & ~infer.has_any(name, ["api", "secret", "token"])) | (infer.is_test_for_rules(path) & infer.has_any(low, TEST_VALUES))


def _severity(rule: Rule, path: Column, config: RuleConfig) -> Column:
    level = config.severity.get(rule.id, rule.severity).lower()
    if level not in ("high", "medium", "low"):
        level = rule.severity
    lower = {"high": "medium", "medium": "low", "low": "low"}[level]
    return F.when(infer.is_test_for_rules(path), lower).otherwise(level) if config.tests_lower else F.lit(level)


def _hinted(low: Column, rule: Rule) -> Column:
    return reduce(lambda a, h: a | F.contains(low, F.lit(h)), rule.hints, F.lit(False)) if rule.hints else F.lit(True)


def findings(files: DataFrame, *, rules: list[Rule] = RULES, config: RuleConfig | None = None, limit: int | None = None) -> DataFrame:
    """path, line_number, rule, severity, confidence, code of files (path, language, content); with a limit the first by path, line and rule.

    A file's lines are exploded once; all rules are tried on a line in one pass, without a join, and patterns only where
    a rule's hints stand.
    """
    config = config or RuleConfig()
    path, line = F.col("path"), F.col("line")
    tried = []
    for rule in rules:
        hit = F.col("language").isin(list(rule.languages)) & _hinted(F.col("low"), rule) & line.rlike(rule.pattern)
        if rule.unless:
            hit = hit & ~line.rlike(rule.unless)
        if rule.id == "possible-secret":
            hit = hit & ~_harmless(line, path, rule)
        for s in config.suppressions:
            if s.get("rule", "*") in ("*", rule.id):
                hit = hit & ~glob(path, s.get("path", "*"))
        tried.append(F.when(hit, F.struct(F.lit(rule.id).alias("rule"), _severity(rule, path, config).alias("severity"), F.lit(rule.confidence).alias("confidence"))))
    low = F.lower("content")
    anything = reduce(lambda a, r: a | (_hinted(low, r) if r.hints else F.col("content").rlike(r.pattern)), rules, F.lit(False))
    lines = files.where(anything).select("path", "language", F.posexplode(tx.split_lines(F.col("content"))).alias("_at", "line")).withColumn("low", F.lower("line"))
    found = lines.select("path", (F.col("_at") + 1).alias("line_number"), F.explode(F.array_compact(F.array(*tried))).alias("_f"), tx.redact(F.trim("line")).alias("code"))
    found = found.select("path", "line_number", "_f.*", "code")
    return found.orderBy("path", "line_number", "rule").limit(limit) if limit else found


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
