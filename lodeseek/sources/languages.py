"""Languages, binary files, ignored paths: fixed tables and the expressions over them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions by language.
EXTENSIONS = {
    "Rust": ["rs"],
    "Python": ["py", "pyw", "pyi"],
    "JavaScript": ["js", "mjs", "cjs"],
    "TypeScript": ["ts", "mts", "cts", "tsx", "jsx"],
    "Go": ["go"],
    "Java": ["java"],
    "C": ["c", "h"],
    "Cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "CSharp": ["cs"],
    "Ruby": ["rb", "rake"],
    "Php": ["php"],
    "Swift": ["swift"],
    "Kotlin": ["kt", "kts"],
    "Shell": ["sh", "bash", "zsh"],
    "Markdown": ["md", "markdown", "txt"],
    "Json": ["json"],
    "Yaml": ["yaml", "yml"],
    "Toml": ["toml"],
    "Sql": ["sql"],
    "Html": ["html", "htm"],
    "Css": ["css", "scss", "sass", "less"],
}
LANGUAGE_OF = {e: name for name, es in EXTENSIONS.items() for e in es}
DISPLAY = {"Cpp": "C++", "CSharp": "C#", "Php": "PHP", "Json": "JSON", "Yaml": "YAML", "Toml": "TOML", "Sql": "SQL", "Html": "HTML", "Css": "CSS", "Dbt": "dbt"}
WITH_EXTRACTOR = ["Rust", "Python", "JavaScript", "TypeScript", "CSharp", "Go", "Java", "C", "Cpp", "Ruby", "Php", "Shell", "Sql", "Dbt"]
EXCLUDED_DIRS = "node_modules target dist build out .git .svn .hg __pycache__ .pytest_cache .tox venv .venv vendor .bundle .gradle .m2 .idea .vscode .vs coverage .nyc_output .cache".split()
BINARY_EXTENSIONS = (
    "exe dll so dylib a o lib bin zip tar gz bz2 xz 7z rar tgz png jpg jpeg gif bmp ico svg webp mp4 avi mov wmv flv mkv webm "
    "mp3 wav ogg flac aac wma pdf doc docx xls xlsx ppt pptx wasm pyc class jar war lock"
).split()
#: What a watcher ignores besides the ignore files, and its binary extensions.
WATCH_PATTERNS = [".git", ".lodeseek.db", "node_modules", "target", ".venv", "__pycache__", "*.dll", "*.exe", "*.so", "*.dylib", "*.pdb", "*.lock", "*.pyc"]
WATCH_BINARY = "dll exe so dylib bin pdb obj o a lib class jar zip tar gz bz2 xz 7z png jpg jpeg gif ico svg pdf doc docx xls xlsx ppt pptx".split()
IGNORE_FILES = (".gitignore", ".lodeseekignore")
SAMPLE = 8192


def extension(path: Column) -> Column:
    """Lower-case extension of the file name; "" for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for e, name in LANGUAGE_OF.items() for x in (e, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("Unknown"))


def display_name(name: Column) -> Column:
    pairs = [F.lit(x) for kv in DISPLAY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def is_indexable(name: Column) -> Column:
    return name != "Unknown"


def has_extractor(name: Column) -> Column:
    return name.isin(WITH_EXTRACTOR)


def in_excluded_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))


def binary_by_extension(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def binary_by_content(content: Column) -> Column:
    """Over the first SAMPLE bytes: a zero byte; or over 30 % unprintable bytes and no valid UTF-8; or
    over 80 %.  Empty content is text."""
    head = F.substring(content, 1, SAMPLE)
    as_bytes = F.decode(head, "ISO-8859-1")
    n = F.length(head)
    odd = n - F.length(F.regexp_replace(as_bytes, r"[^\x09\x0A\x0D\x20-\x7E]", ""))
    share = odd / n
    valid = F.is_valid_utf8(head.cast("string"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(False)).otherwise(as_bytes.contains("\x00") | ((share > 0.3) & ~valid) | (share > 0.8))


def is_dbt(content: Column) -> Column:
    """Whether SQL text is a template: any statement tags, or expression tags with a known call."""
    tags = content.contains("{%") & content.contains("%}")
    expressions = content.contains("{{") & content.contains("}}")
    calls = content.rlike(r"(?:ref|source|config) ?\(")
    return tags | (expressions & calls)


def rule(pattern: str) -> tuple[str, bool, bool] | None:
    """A line of an ignore file as (regex over an entry's path below the file's folder, whether it takes
    back, whether it is for folders alone), or None."""
    line = re.sub(r"(?<!\\)\s+\Z", "", pattern)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    only_dir, line = line.endswith("/"), line.rstrip("/")
    rooted = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (j := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", j + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return rf"\A{'' if rooted else '(?:.*/)?'}{out}\z", back, only_dir


def pattern_to_regex(pattern: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regex over a file's path, whether it takes back), or None; files
    below a folder that matches match too."""
    if not (got := rule(pattern)):
        return None
    return got[0].removesuffix(r"\z") + ("/.*" if got[2] else "(?:/.*)?") + r"\z", got[1]


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches the path, or a folder above it, ignores it."""
    verdict = F.lit(False)
    for p in patterns:
        if got := pattern_to_regex(p):
            verdict = F.when(relative.rlike(got[0]), F.lit(not got[1])).otherwise(verdict)
    return verdict
