"""Symbols, imports, calls, parents and references of source files: one row a file, by a Python worker.

Python by its own syntax tree; JavaScript and TypeScript by patterns and matched braces. A file that doesn't parse has
an error and no records. New languages register a function in PARSERS.
"""

from __future__ import annotations

import ast
import bisect
import gc
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "struct<qualified_name:string,name:string,kind:string,module:string,line_start:int,line_end:int,docstring:string,decorators:array<string>,signature:string,parent:string>"
IMPORT = "struct<module:string,name:string,alias:string,line_number:int,is_from:boolean>"
CALL = "struct<caller:string,target:string,display:string,arguments:array<string>,line_number:int>"
PARENT = "struct<child:string,parent:string,line_number:int>"
REFERENCE = "struct<source:string,name:string,line_number:int>"
PARSED = f"path string, language string, error string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, calls array<{CALL}>, inherits array<{PARENT}>, refs array<{REFERENCE}>"


def module_of(path: str) -> str:
    stem = re.sub(r"\.[^./]+$", "", path).replace("/", ".")
    return stem.removesuffix(".__init__") if path.endswith(".py") else stem


def _empty() -> dict:
    return {"error": None, "symbols": [], "imports": [], "calls": [], "inherits": [], "refs": []}


#: Fields that hold statements, or what holds statements, in the order in which nodes have them.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """All statements in the order of ast.walk; expressions hold none, so they are not entered."""
    found = deque([tree])
    while found:
        node = found.popleft()
        yield node
        for name in _BLOCKS:
            found += getattr(node, name, ())


#: Fields of a type of nodes that may hold nodes with names; contexts and operators have none.
_FIELDS: dict[type, list[str]] = {}


def _children(node: ast.AST) -> list[ast.AST]:
    kind = type(node)
    if (fields := _FIELDS.get(kind)) is None:
        fields = _FIELDS[kind] = [f for f in kind._fields if f not in ("ctx", "op", "ops")]
    found: list[ast.AST] = []
    for field in fields:
        value = getattr(node, field, None)
        if isinstance(value, list):
            found += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            found.append(value)
    return found


class _Python:
    """Definitions in bodies of modules, classes and functions; calls and names in functions, but not in nested definitions."""

    DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)

    def __init__(self, path: str, content: str):
        self.module, self.out = module_of(path), _empty()
        tree = ast.parse(content)
        # texts are cut out of lines that are split once: as ast counts lines, and as heads of definitions are shown
        self.raw, self.lines = re.findall(rb"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+\Z", content.encode()), content.splitlines()
        for node in _statements(tree):
            if isinstance(node, ast.Import):
                self.out["imports"] += [{"module": a.name, "name": None, "alias": a.asname, "line_number": node.lineno, "is_from": False} for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                base = "." * node.level + (node.module or "")
                self.out["imports"] += [{"module": base, "name": a.name, "alias": a.asname, "line_number": node.lineno, "is_from": True} for a in node.names]
        self._body(tree.body, self.module, None)

    def _text(self, node: ast.AST) -> str:
        first, last, start, end = node.lineno - 1, node.end_lineno - 1, node.col_offset, node.end_col_offset
        cut = [self.raw[first][start:end]] if first == last else [self.raw[first][start:], *self.raw[first + 1 : last], self.raw[last][:end]]
        return b"".join(cut).decode() or ast.unparse(node)

    def _body(self, body: list, scope: str, owner: str | None) -> None:
        for node in body:
            if isinstance(node, self.DEFINITIONS):
                self._definition(node, scope, owner)

    def _definition(self, node, scope: str, owner: str | None) -> None:
        qualified, is_class = f"{scope}.{node.name}", isinstance(node, ast.ClassDef)
        kind = "CLASS" if is_class else "METHOD" if owner == "CLASS" else "FUNCTION"
        head = self.lines[node.lineno - 1].strip().rstrip(":")
        self.out["symbols"].append({"qualified_name": qualified, "name": node.name, "kind": kind, "module": self.module, "line_start": node.lineno, "line_end": node.end_lineno, "docstring": ast.get_docstring(node), "decorators": [self._text(d) for d in node.decorator_list], "signature": head, "parent": scope if owner else None})
        if is_class:
            bases = [*node.bases, *node.keywords]
            self.out["inherits"] += [{"child": qualified, "parent": self._text(b), "line_number": node.lineno} for b in bases]
        else:
            self._uses(node, qualified)
        self._body(node.body, qualified, kind)

    def _uses(self, function, qualified: str) -> None:
        stack = function.body[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, self.DEFINITIONS):
                continue
            if isinstance(node, ast.Call):
                display = self._text(node.func)
                names = re.findall(r"[A-Za-z_]\w*", display)
                arguments = [self._text(a) for a in [*node.args, *node.keywords]]
                if names:
                    self.out["calls"].append({"caller": qualified, "target": names[-1], "display": display, "arguments": arguments, "line_number": node.lineno})
            name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None
            if name and name not in ("self", "cls"):
                self.out["refs"].append({"source": qualified, "name": name, "line_number": node.lineno})
            stack += _children(node)[::-1]


def parse_python(path: str, content: str) -> dict:
    return _Python(path, content).out


#: Patterns of JavaScript and TypeScript, and words before a parenthesis that are no calls.
_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]")
_BARE_IMPORT = re.compile(r"\bimport\s+['\"]([^'\"]+)['\"]")
_REQUIRE = re.compile(r"\bconst\s+(\w+)\s*=\s*require\(['\"]([^'\"]+)['\"]\)")
_CLASS = re.compile(r"^\s*(?:export\s+default\s+|export\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?", re.M)
_FUNCTION = re.compile(r"^\s*(?:export\s+default\s+|export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", re.M)
_ARROW = re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", re.M)
_ROUTE = re.compile(r"\b(?:app|router)\.(get|post|put|patch|delete|use)\s*\(\s*['\"]([^'\"]+)['\"]", re.I)
_TEST = re.compile(r"\b(describe|it|test)\s*\(\s*['\"]([^'\"]+)['\"]")
_METHOD = re.compile(r"^\s{2,}(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", re.M)
_CALLED = re.compile(r"(?<!function\s)\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return"}
_ROUTERS, _ROUTE_METHODS = {"app", "router"}, {"get", "post", "put", "patch", "delete", "use"}


def _imported(clause: str) -> list[tuple[str | None, str | None]]:
    """(name, alias) of what an import clause brings: a default, names in braces, a namespace (an alias without a name)."""
    head, braces, space = clause.split(",")[0].strip(), re.search(r"\{([^}]+)\}", clause), re.search(r"\*\s+as\s+(\w+)", clause)
    found: list[tuple[str | None, str | None]] = [] if not head or head[0] in "{*" else [(head, None)]
    for item in map(str.strip, braces[1].split(",") if braces else ()):
        name, _, alias = item.partition(" as ")
        if item:
            found.append((name.strip(), alias.strip() or None))
    if space:
        found.append((None, space[1]))
    return found or [(None, None)]


def _slug(text: str) -> str:
    return re.sub(r"[\W_]+", "_", text.lower()).strip("_")[:48] or "unnamed"


class _JavaScript:
    """Symbols by patterns, a symbol's lines up to the brace that closes its first one, calls by a pattern over those lines."""

    def __init__(self, path: str, content: str):
        self.content, self.module, self.out = content, module_of(path), _empty()
        self.lines = content.splitlines()
        self.starts = [0, *(m.end() for m in re.finditer("\n", content))]
        for number, line in enumerate(self.lines, 1):
            record = lambda module, name, alias, is_from: self.out["imports"].append({"module": module, "name": name, "alias": alias, "line_number": number, "is_from": is_from})  # noqa: E731, B023
            for m in _IMPORT.finditer(line):
                for name, alias in _imported(m[1]):
                    record(m[2], name, alias, True)
            for m in _BARE_IMPORT.finditer(line):
                record(m[1], None, None, False)
            for m in _REQUIRE.finditer(line):
                record(m[2], None, m[1], False)
        self.taken: set[str] = set()
        classes = []
        for m in _CLASS.finditer(content):
            span = self._symbol(m, m[1], "CLASS")
            classes.append((span, f"{self.module}.{m[1]}"))
            if m[2]:
                self.out["refs"].append({"source": f"{self.module}.{m[1]}", "name": m[2].rpartition(".")[2], "line_number": span[0]})
        for pattern in (_FUNCTION, _ARROW):
            for m in pattern.finditer(content):
                self._symbol(m, m[1], "FUNCTION")
        for m in _ROUTE.finditer(content):
            self._symbol(m, f"route_{m[1].lower()}_{_slug(m[2])}", "FUNCTION")
        for m in _TEST.finditer(content):
            self._symbol(m, f"{m[1]}_{_slug(m[2])}", "FUNCTION")
        for m in _METHOD.finditer(content):
            inside = [(span[0], name) for span, name in classes if span[0] < self._line(m.start()) <= span[1]]
            if inside:
                self._symbol(m, m[1], "METHOD", max(inside, key=lambda x: x[0])[1])
        for symbol in sorted(self.out["symbols"], key=lambda x: x["line_start"]):
            self._calls(symbol)

    def _line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def _end(self, at: int) -> int:
        """The line of the brace that closes the first one behind `at`, or the line of `at` where none does."""
        depth, opened = 0, False
        for m in re.compile("[{}]").finditer(self.content, at):
            opened |= m[0] == "{"
            depth += 1 if m[0] == "{" else -1
            if opened and depth <= 0 and m[0] == "}":
                return self._line(m.start())
        return self._line(at)

    def _symbol(self, m: re.Match, name: str, kind: str, parent: str | None = None) -> tuple[int, int]:
        first = self._line(m.start())
        last, qualified = max(first, self._end(m.end())), f"{parent or self.module}.{name}"
        if qualified not in self.taken:
            self.taken.add(qualified)
            head = self.lines[first - 1].strip() if first <= len(self.lines) else ""
            self.out["symbols"].append({"qualified_name": qualified, "name": name, "kind": kind, "module": self.module, "line_start": first, "line_end": last, "docstring": None, "decorators": [], "signature": head or None, "parent": parent})
        return first, last

    def _calls(self, symbol: dict) -> None:
        body = "\n".join(self.lines[symbol["line_start"] - 1 : symbol["line_end"]])
        for m in _CALLED.finditer(body):
            owner, _, target = m[1].rpartition(".")
            if owner in _ROUTERS and target.lower() in _ROUTE_METHODS:
                target = f"route_{target.lower()}"
            if target not in _KEYWORDS:
                self.out["calls"].append({"caller": symbol["qualified_name"], "target": target, "display": m[1], "arguments": [], "line_number": symbol["line_start"] + body.count("\n", 0, m.start())})


def parse_javascript(path: str, content: str) -> dict:
    return _JavaScript(path, content).out


PARSERS: dict[str, Callable[[str, str], dict]] = {"python": parse_python, "javascript": parse_javascript}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[str, str], dict]] | None = None, *, spread: bool = False) -> DataFrame:
    """PARSED rows of files (path, language, content), parsed one at a time; files are spread by path, unless they are spread already."""
    parsers = parsers or PARSERS
    names = ["symbols", "imports", "calls", "inherits", "refs"]
    spark = files.sparkSession
    schema = spark.createDataFrame([], PARSED).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # trees and records hold no cycles, so the collector would only walk over a batch's records again and again
        gc.disable()
        try:
            yield from parsed(batches)
        finally:
            gc.enable()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    parse = parsers.get(row["language"])
                    made = parse(row["path"], row["content"] or "") if parse else _empty() | {"error": f"no parser for {row['language']}"}
                except (SyntaxError, ValueError, RecursionError) as e:
                    made = _empty() | {"error": f"{type(e).__name__}: {e}"}
                rows.append({"path": row["path"], "language": row["language"], "error": made["error"], **{n: made[n] for n in names}})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # a set number of parts: texts that come in one small file, or that little is written of, still go to all tasks
    texts = files.select("path", "language", "content")
    if not spread:
        texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return texts.mapInArrow(run, PARSED)


def exploded(parsed: DataFrame, name: str) -> DataFrame:
    """path and the fields of one kind of record."""
    return parsed.select("path", F.explode(name).alias("_r")).select("path", "_r.*")
