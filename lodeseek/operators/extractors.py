"""Definitions in source code: Python by its own parser, other languages by a lexical scanner.

The scanner blanks out strings and comments, finds headers by the language's patterns and closes
each body by braces, indentation or ``end``.  It approximates a grammar: macros that unbalance braces
or headers over many lines can be missed.  Chunks nest: a class and its methods both appear.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, start_line int, end_line int, kind string, name string, signature string, docstring string, context array<string>, content string"


@dataclass(frozen=True)
class Header:
    """A pattern for one kind of definition; its groups: name, and params, ret, of where there are."""

    pattern: str
    kind: str
    inner: str | None = None  # the kind within a class-like body
    signature: str | None = None


@dataclass(frozen=True)
class Grammar:
    headers: list[Header]
    close: str = "brace"  # brace, end or statement
    line_comment: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'`"
    doc: tuple[str, ...] = ("///", "/**")
    classes: frozenset = field(default_factory=lambda: frozenset({"Class", "Struct", "Interface", "Impl", "Trait", "Enum"}))


_N = r"(?P<name>[A-Za-z_][\w:~]*)"
_G = r"(?P<generic><[^{}()]*>)?"
_P = r"\s*(?P<params>\([^()]*(?:\([^()]*\)[^()]*)*\))"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|partial|readonly|synchronized|native|default|extern|unsafe)\s+)*"
_RUST = r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|async\s+|const\s+|unsafe\s+|extern\s+)*"

GRAMMARS: dict[str, Grammar] = {
    "Rust": Grammar(
        [
            Header(rf"^\s*{_RUST}fn\s+{_N}\s*{_G}{_P}(?:\s*->\s*(?P<ret>[^{{;]+?))?\s*(?:where[^{{]*)?(?=[{{;])", "Function", "Method", "fn {name}{generic}{params} -> {ret}"),
            Header(rf"^\s*{_RUST}struct\s+{_N}\s*{_G}", "Struct", None, "struct {name}{generic}"),
            Header(rf"^\s*{_RUST}enum\s+{_N}\s*{_G}", "Enum", None, "enum {name}{generic}"),
            Header(rf"^\s*{_RUST}impl\s*(?P<generic><[^{{}}()]*>)?\s*(?P<of>[^{{]+?)\s*(?=\{{)", "Impl", None, "impl{generic} {of}"),
            Header(rf"^\s*{_RUST}trait\s+{_N}\s*{_G}", "Trait", None, "trait {name}{generic}"),
            Header(rf"^\s*{_RUST}type\s+{_N}", "TypeAlias"),
            Header(rf"^\s*{_RUST}mod\s+{_N}", "Mod"),
            Header(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+{_N}\s*:", "Const"),
            Header(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?{_N}\s*:", "Static"),
        ],
        quotes='"',
        classes=frozenset({"Impl"}),
    ),
    "JavaScript": Grammar(
        [
            Header(rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_N}\s*{_G}{_P}", "Function", None, "function {name}{params}"),
            Header(rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_N}", "Class", None, "class {name}"),
            Header(rf"^\s*(?:export\s+)?interface\s+{_N}", "Interface"),
            Header(rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_N}", "Enum"),
            Header(rf"^\s*(?:export\s+)?type\s+{_N}[^=\n]*=", "TypeAlias"),
            Header(rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_N}[^=\n]*=", "Function"),
            Header(rf"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!(?:if|for|while|switch|catch|return|function|else)\b){_N}\s*{_G}{_P}[^{{;\n]*(?=\{{)", "Method"),
        ],
        doc=("/**",),
    ),
    "CSharp": Grammar(
        [
            Header(rf"^\s*{_MODS}(?:class|record)\s+{_N}\s*{_G}", "Class", None, "class {name}{generic}"),
            Header(rf"^\s*{_MODS}struct\s+{_N}\s*{_G}", "Struct", None, "struct {name}{generic}"),
            Header(rf"^\s*{_MODS}interface\s+{_N}\s*{_G}", "Interface", None, "interface {name}{generic}"),
            Header(rf"^\s*{_MODS}enum\s+{_N}", "Enum"),
            Header(r"^\s*namespace\s+(?P<name>[\w.]+)", "Mod"),
            Header(rf"^\s*{_MODS}delegate\s+[\w<>\[\],.? ]+?\s+{_N}{_P}", "TypeAlias"),
            Header(rf"^\s*{_MODS}(?P<ret>(?!return|new|throw|else|await)[\w<>\[\],.?]+)\s+{_N}\s*{_G}{_P}\s*(?:where[^{{]*)?(?=\{{|=>|;)", "Function", "Method", "{ret} {name}{generic}{params}"),
            Header(rf"^\s*{_MODS}[\w<>\[\],.?]+\s+{_N}\s*(?=\{{\s*(?:get|set|init|private))", "Other"),
        ],
    ),
    "Go": Grammar(
        [
            Header(rf"^func\s+(?P<of>\([^)]*\))\s*{_N}{_P}", "Method", None, "func {of} {name}{params}"),
            Header(rf"^func\s+{_N}\s*(?:\[[^\]]*\])?{_P}\s*(?P<ret>[^{{\n]*?)\s*(?=\{{)", "Function", None, "func {name}{params} {ret}"),
            Header(rf"^\s*type\s+{_N}", "Struct", None, "type {name}"),
        ],
        doc=("//", "/*"),
    ),
    "Java": Grammar(
        [
            Header(rf"^\s*{_MODS}(?:class|record)\s+{_N}\s*{_G}", "Class", None, "class {name}{generic}"),
            Header(rf"^\s*{_MODS}@?interface\s+{_N}\s*{_G}", "Interface", None, "interface {name}{generic}"),
            Header(rf"^\s*{_MODS}enum\s+{_N}", "Enum", None, "enum {name}"),
            Header(rf"^\s*{_MODS}(?:<[^>]*>\s*)?(?:(?P<ret>(?!return|new|throw|else)[\w<>\[\],.?]+)\s+)?(?!(?:if|for|while|switch|catch|synchronized|return)\b){_N}{_P}\s*(?:throws[^{{;]*)?(?=\{{)", "Method", None, "{ret} {name}{params}"),
        ],
        doc=("/**",),
    ),
    "C": Grammar(
        [
            Header(rf"^\s*(?:typedef\s+)?struct\s+{_N}\s*(?=[{{:])", "Struct", None, "struct {name}"),
            Header(rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_N}[^;{{]*(?=\{{)", "Class", None, "class {name}"),
            Header(rf"^\s*enum\s+(?:class\s+)?{_N}[^;{{]*(?=\{{)", "Enum"),
            Header(rf"^\s*namespace\s+{_N}\s*(?=\{{)", "Mod"),
            Header(rf"^(?!\s*(?:else|return|if|for|while|switch)\b)\s*(?P<ret>[A-Za-z_][\w:<>,&*\s]*?[\s&*]+){_N}{_P}[^;{{()]*(?=\{{)", "Function", None, "{ret} {name}{params}"),
            Header(rf"^(?!\s*(?:else|return|using|typedef|goto|delete|throw)\b)[A-Za-z_][\w:<>,&*]*\s+[&*]*{_N}\s*(?:{_P})?\s*(?:=[^;{{}}]*)?;", "Other"),
        ],
    ),
    "Ruby": Grammar(
        [
            Header(rf"^\s*def\s+(?P<name>(?:self\.)?[\w?!=]+)(?P<params>\([^)]*\))?", "Function", "Method", "def {name}{params}"),
            Header(r"^\s*class\s+(?P<name>[\w:]+)", "Class", None, "class {name}"),
            Header(r"^\s*module\s+(?P<name>[\w:]+)", "Mod", None, "module {name}"),
        ],
        close="end",
        line_comment=("#",),
        block=None,
        doc=("#",),
        classes=frozenset({"Class", "Mod"}),
    ),
    "Php": Grammar(
        [
            Header(rf"^\s*{_MODS}function\s+&?{_N}{_P}", "Function", "Method", "function {name}{params}"),
            Header(rf"^\s*{_MODS}class\s+{_N}", "Class", None, "class {name}"),
            Header(rf"^\s*interface\s+{_N}", "Interface", None, "interface {name}"),
            Header(rf"^\s*trait\s+{_N}", "Trait", None, "trait {name}"),
            Header(rf"^\s*enum\s+{_N}", "Enum"),
        ],
        line_comment=("//", "#"),
        doc=("/**",),
    ),
    "Shell": Grammar([Header(r"^\s*(?:function\s+)?(?P<name>[\w:-]+)\s*\(\s*\)\s*(?=\{)|^\s*function\s+(?P<name2>[\w:-]+)\s*(?=\{)", "Function", None, "function {name}")], line_comment=("#",), block=None, doc=("#",)),
    "Sql": Grammar(
        [
            Header(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)", "Struct", None, "CREATE TABLE {name}"),
            Header(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?P<of>(?:materialized\s+)?view|type)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)", "TypeAlias", None, "CREATE {of} {name}"),
            Header(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?P<of>function|procedure|trigger)\s+(?P<name>[\w.\"`]+)\s*(?P<params>\([^()]*\))?", "Function", None, "CREATE {of} {name}{params}"),
            Header(r"(?i)^\s*create\s+(?P<of>schema|database)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)", "Mod", None, "CREATE {of} {name}"),
            Header(r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)", "Other", None, "CREATE INDEX {name}"),
            Header(r"(?i)(?:^\s*with\s+(?:recursive\s+)?|^\s*,?\s*)(?P<name>\w+)\s+as\s*\(\s*$", "Block", None, "WITH {name} AS"),
        ],
        close="statement",
        line_comment=("--",),
        quotes="'",
        doc=("--", "/*"),
    ),
}
GRAMMARS["TypeScript"] = GRAMMARS["JavaScript"]
GRAMMARS["Cpp"] = GRAMMARS["C"]
_COMPILED = {name: [(re.compile(h.pattern, re.M), h) for h in g.headers] for name, g in GRAMMARS.items()}


def label(kind: str, name: str | None) -> str:
    return f"{kind}: {name}" if name else kind


def blanked(text: str, g: Grammar) -> str:
    """The text with the insides of strings and comments as spaces; lines stay."""
    comments = [re.escape(c) + r"[^\n]*" for c in g.line_comment]
    if g.block:
        comments.append(re.escape(g.block[0]) + r"[\s\S]*?(?:" + re.escape(g.block[1]) + r"|\Z)")
    strings = [rf"{q}(?:[^{q}\\\n]|\\[\s\S])*{q}" if q != "`" else r"`(?:[^`\\]|\\[\s\S])*`" for q in g.quotes]
    return re.sub("|".join(comments + strings), lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end_of_body(code: str, at: int, g: Grammar) -> int:
    """Where the definition that begins before ``at`` ends."""
    if g.close == "statement":
        i = code.find(";", at)
        return len(code) if i < 0 else i + 1
    if g.close == "end":
        depth = 1
        for m in re.finditer(r"^[ \t]*(?:(class|module|def|if|unless|case|while|until|begin|for)\b|(end)\b)|\b(do)\b(?=[^\n]*$)|=\s*(if|case|begin)\b", code[at:], re.M):
            depth += -1 if m[2] else 1
            if not depth:
                return at + m.end()
        return len(code)
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not depth:
            return m.end()
    return len(code)


def _doc_before(rows: list[str], start: int, marks: tuple[str, ...]) -> str | None:
    """The comment right above a line."""
    i, own = start - 1, []
    if i >= 0 and rows[i].rstrip().endswith("*/"):
        while i >= 0:
            own.insert(0, rows[i])
            if rows[i].lstrip().startswith("/*"):
                break
            i -= 1
    else:
        while i >= 0 and rows[i].lstrip().startswith(tuple(m for m in marks if not m.startswith("/*"))):
            own.insert(0, rows[i])
            i -= 1
    text = "\n".join(own).strip()
    return text if text and text.startswith(marks) else None


def _signature(h: Header, m: re.Match) -> str | None:
    if not h.signature:
        return None
    got = {k: " ".join((v or "").split()) for k, v in m.groupdict().items()}
    got["name"] = got.get("name") or got.get("name2", "")
    filled = h.signature
    for key in ("name", "generic", "params", "ret", "of"):
        filled = filled.replace("{" + key + "}", got.get(key, ""))
    return re.sub(r" -> \Z", "", filled).strip()


def scan(path: str, language: str, text: str) -> list[dict]:
    """Definitions of a text by the language's grammar, in order, with the labels around each."""
    g, rows = GRAMMARS[language], text.split("\n")
    code = blanked(text, g)
    found = []
    for pattern, h in _COMPILED[language]:
        for m in pattern.finditer(code):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            name = m.groupdict().get("name") or m.groupdict().get("name2")
            found.append({"a": start, "b": _end_of_body(code, m.end(), g), "header": h, "m": m, "name": name})
    found.sort(key=lambda d: (d["a"], -d["b"]))
    out, stack, taken = [], [], set()
    for d in found:
        if d["a"] in taken:
            continue
        taken.add(d["a"])
        while stack and stack[-1]["b"] <= d["a"]:
            stack.pop()
        h, inside = d["header"], bool(stack) and stack[-1]["kind"] in g.classes
        d["kind"] = h.inner if h.inner and inside else h.kind
        if h.kind == "Other" and any(s["kind"] in ("Function", "Method") for s in stack):
            continue
        start, end = text.count("\n", 0, d["a"]), text.count("\n", 0, max(d["a"], d["b"] - 1)) + 1
        out.append(
            {
                "path": path,
                "start_line": start,
                "end_line": end,
                "kind": d["kind"],
                "name": d["name"],
                "signature": _signature(h, d["m"]),
                "docstring": _doc_before(rows, start, g.doc),
                "context": [f"File: {path}", *(label(s["kind"], s["name"]) for s in stack), label(d["kind"], d["name"])],
                "content": "\n".join(rows[start:end]),
            }
        )
        stack.append(d)
    return out


def scan_python(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows, out = text.split("\n"), []

    def visit(node, context, in_class):
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                visit(child, context, False if not isinstance(child, ast.If | ast.Try | ast.With) else in_class)
                continue
            is_class = isinstance(child, ast.ClassDef)
            kind = "Class" if is_class else "Method" if in_class else "Function"
            if is_class:
                bases = ", ".join(ast.unparse(b) for b in [*child.bases, *(k for k in child.keywords)]) if child.bases or child.keywords else ""
                signature = f"class {child.name}({bases})" if bases else f"class {child.name}"
            else:
                signature = f"def {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
            first = child.body[0]
            doc = None
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                doc = ast.get_source_segment(text, first.value)
            here = [*context, label(kind, child.name)]
            out.append({"path": path, "start_line": child.lineno - 1, "end_line": child.end_lineno, "kind": kind, "name": child.name, "signature": signature, "docstring": doc, "context": here, "content": "\n".join(rows[child.lineno - 1 : child.end_lineno])})
            visit(child, here, is_class)

    visit(tree, [f"File: {path}"], False)
    return out


# ---- templated SQL


def call(name: str) -> str:
    """An expression that calls ``name``; its arguments, which may have brackets within, are group 1."""
    return r"\{\{-?\s*" + name + r"\s*\(((?:[^()]|\([^()]*\))*)\)[^{}]*\}\}"


def tag(body: str) -> str:
    """A statement tag, with or without the marks that trim blanks."""
    return r"\{%-?\s*" + body + r"\s*-?%\}"


_NAMED = r"\w+\s*=\s*[^,]*"  # an argument with a name, as a model's version
_TEXT = r"""'([^']*)'|"([^"]*)\""""
_MACRO, _END_MACRO = tag(r"macro\s+(\w+)\s*\(([^)]*)\)"), tag(r"endmacro(?:\s+\w+)?")
_DOCS = tag(r"docs\s+\w+") + r"([\s\S]*?)" + tag("enddocs")
_DESCRIPTION = r"description\s*=\s*['\"]([^'\"]*)['\"]"
# Fixed value: lines of a macro whose end is missing.
MACRO_LINES = 10


def _names(arguments: Column) -> Column:
    """The texts among the arguments without a name."""
    found = F.regexp_extract_all(F.regexp_replace(arguments, _NAMED, ""), F.lit(_TEXT), 0)
    return F.transform(found, lambda x: F.substr(x, F.lit(2), F.length(x) - 2))


def dbt_refs(text: Column) -> Column:
    """The models referred to; the last name of a call, before which its package may stand."""
    calls = F.transform(F.regexp_extract_all(text, F.lit(call("ref")), 1), _names)
    return F.transform(F.filter(calls, lambda x: F.size(x) > 0), lambda x: F.element_at(x, -1))


def dbt_sources(text: Column) -> Column:
    calls = F.transform(F.regexp_extract_all(text, F.lit(call("source")), 1), _names)
    return F.transform(F.filter(calls, lambda x: F.size(x) == 2), lambda x: F.array_join(x, "."))


def dbt_config(text: Column) -> Column:
    return F.when(text.rlike(call("config")), F.trim(F.regexp_extract(text, call("config"), 1)))


def _texts(arguments: str) -> list[str]:
    return [a or b for a, b in re.findall(_TEXT, re.sub(_NAMED, "", arguments))]


def macros(text: str) -> list[tuple[str, str, int, int]]:
    """(name, arguments, first line, end line) of each macro."""
    out = []
    for m in re.finditer(_MACRO, text):
        start = text.count("\n", 0, m.start())
        end = re.search(_END_MACRO, text[m.end() :])
        out.append((m[1], m[2], start, start + MACRO_LINES if not end else text.count("\n", 0, m.end() + end.end()) + 1))
    return out


def scan_dbt(path: str, text: str) -> list[dict]:
    """Macros, and the statements of the SQL; what the file refers to is every one's signature."""
    rows, found = text.split("\n"), macros(text)
    refs = [x[-1] for x in map(_texts, re.findall(call("ref"), text)) if x]
    sources = [x for x in map(_texts, re.findall(call("source"), text)) if len(x) == 2]
    config = re.search(call("config"), text)
    parts = ([f"config: {config[1].strip()}"] if config else []) + ([f"refs: [{', '.join(refs)}]"] if refs else []) + ([f"sources: [{', '.join('.'.join(s) for s in sources)}]"] if sources else [])
    signature = f"macro {found[0][0]}({found[0][1]})" if found else " | ".join(parts) or None
    described = re.search(_DOCS, text) or re.search(_DESCRIPTION, text)
    out = [
        {"path": path, "start_line": s, "end_line": min(e, len(rows)), "kind": "Function", "name": n, "signature": signature, "docstring": described[1].strip() if described else None, "context": [f"File: {path}", label("Function", n)], "content": "\n".join(rows[s : min(e, len(rows))])}
        for n, _, s, e in found
    ]
    for d in scan(path, "Sql", text):
        out.append(d | {"kind": "Block" if d["kind"] == "Block" else "Function", "signature": signature or d["signature"], "docstring": described[1].strip() if described else d["docstring"]})
    return sorted(out, key=lambda d: d["start_line"])


def definitions_of(path: str, language: str, text: str | None) -> list[dict]:
    if not text:
        return []
    if language == "Python":
        return scan_python(path, text)
    if language == "Dbt":
        return scan_dbt(path, text)
    return scan(path, language, text) if language in GRAMMARS else []


def _extract(batches):
    for b in batches:
        rows = [d for p, g, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for d in definitions_of(p, g, t)]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def definitions(files: DataFrame) -> DataFrame:
    """files: path, language, content.  One row per definition; see SCHEMA."""
    return files.select("path", "language", "content").mapInArrow(_extract, SCHEMA)


SAMPLES = [
    ("a.py", "Python", 'class A(Base):\n    """Doc."""\n    def m(self, x: int) -> str:\n        return "x"\n\n\ndef f():\n    pass\n'),
    ("b.rs", "Rust", "/// Adds.\npub fn add<T>(a: T, b: T) -> T {\n    a\n}\nstruct P { x: i32 }\nimpl P {\n    fn new() -> Self { P { x: 1 } }\n}\n"),
    ("c.ts", "TypeScript", "/** Doc */\nexport function go(a: string) { return '{'; }\nexport class C {\n  run() {\n    go('x');\n  }\n}\nconst k = 1;\n"),
    ("d.cs", "CSharp", "namespace N {\n  /// <summary>S</summary>\n  public class D {\n    public int Add(int a) { return a; }\n  }\n}\n"),
    ("e.go", "Go", "package p\n// Doc\nfunc F(a int) int {\n\treturn a\n}\nfunc (r *R) M() {\n}\ntype R struct {\n}\n"),
    ("f.java", "Java", "/** Doc */\npublic class J {\n  public int m(int a) {\n    return a;\n  }\n}\n"),
    ("g.c", "C", "/** Doc */\nint add(int a, int b) {\n  return a + b;\n}\nstruct S { int x; };\n"),
    ("h.rb", "Ruby", "# Doc\nmodule M\n  class K\n    def go(x)\n      if x\n        1\n      end\n    end\n  end\nend\n"),
    ("i.php", "Php", "<?php\n/** Doc */\nfunction go($a) {\n  return $a;\n}\nclass K {\n  public function m() {}\n}\n"),
    ("j.sh", "Shell", "# Doc\nrun() {\n  echo '}'\n}\n"),
    ("k.sql", "Sql", "-- Doc\nCREATE TABLE t (\n  a int\n);\nCREATE OR REPLACE FUNCTION f(a int) RETURNS int AS 'x' ;\n"),
    ("l.sql", "Dbt", "{{ config(materialized='table') }}\nselect * from {{ ref('a') }} join {{ source('s', 't') }}\n{% macro m(x) %}\n  {{ x }}\n{% endmacro %}\n"),
]
