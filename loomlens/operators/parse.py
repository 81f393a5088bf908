"""The parse stage: one file to its masked text, symbols, imports and exports. Pure Python for each file, run over Arrow
batches. Sequential scans with state are the part of the engine that column expressions can't say."""

from __future__ import annotations

import functools
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from . import grammar
from .spread import spread

SYMBOLS_MAX, IMPORTS_MAX, SIGNATURE_MAX, DOC_MAX = 2000, 400, 200, 160

# Languages by file ending, and by name.
ENDINGS = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "swift": "swift", "csharp": "cs",
    "c": "c h", "cpp": "cc cpp cxx hpp hh", "ruby": "rb", "php": "php", "shell": "sh bash zsh", "sql": "sql", "css": "css scss less", "markdown": "md mdx", "json": "json jsonc", "yaml": "yml yaml", "toml": "toml", "html": "html htm vue svelte",
}
LANGUAGE = {ending: name for name, endings in ENDINGS.items() for ending in endings.split()}
NAMES = {"makefile": "shell", "dockerfile": "shell", ".bashrc": "shell", ".zshrc": "shell", "cargo.toml": "toml", "go.mod": "text"}


@dataclass(frozen=True)
class Syntax:
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    long: tuple[str, ...] = ()
    template: bool = False
    regex: bool = False


SYNTAX = {
    "typescript": Syntax(template=True, regex=True), "javascript": Syntax(template=True, regex=True), "python": Syntax(("#",), (), long=('"""', "'''")), "go": Syntax(long=("`",)), "ruby": Syntax(("#",), ()), "shell": Syntax(("#",), ()),
    "sql": Syntax(("--",)), "yaml": Syntax(("#",), ()), "toml": Syntax(("#",), (), long=('"""', "'''")), "php": Syntax(("//", "#")), "rust": Syntax(quotes='"'), "swift": Syntax(quotes='"', long=('"""',)), "kotlin": Syntax(long=('"""',)), "css": Syntax(()),
}
TEXTUAL = ("markdown", "json", "html", "text")
FLAT = ("shell", "sql")
SCRIPT = ("typescript", "javascript")


BEFORE_REGEX = frozenset("return typeof case in of void delete throw else do await yield".split())


@functools.cache
def _special(syntax: Syntax) -> re.Pattern:
    """What can begin or end something to mask."""
    marks = [*syntax.line, *(x[0] for x in syntax.block), *syntax.long, *syntax.quotes, *("`{}" if syntax.template else ""), *("/" if syntax.regex else "")]
    return re.compile("|".join(map(re.escape, sorted(set(marks), key=len, reverse=True))))


def detect_language(path: str) -> str:
    base = posixpath.basename(path).lower()
    return NAMES.get(base) or LANGUAGE.get(base.rpartition(".")[2] if "." in base[1:] else "", "text")


def mask_source(source: str, language: str) -> str:
    """source with comments, strings and regular expressions blanked: the same length and line breaks."""
    if language in TEXTUAL:
        return source
    syntax, out, i, n = SYNTAX.get(language, Syntax()), list(source), 0, len(source)
    special, after, holes = _special(syntax), 0, []  # after: the end of the last literal; holes: brace depths in templates

    def operand(i: int) -> bool:
        """Whether what stands before i is a value, after which a slash divides."""
        code = "".join(out[max(after, i - 200) : i]).rstrip()
        if not code:
            return after > 0
        word = re.search(r"[\w$]+$", code)
        return word[0] not in BEFORE_REGEX if word else code[-1] in ")]"

    def blank(a: int, b: int) -> int:
        for k in range(a, min(b, n)):
            if out[k] not in "\r\n":
                out[k] = " "
        return b

    def template(i: int) -> int:
        """From inside a template to its end, or to the hole that interrupts it."""
        a = i
        while i < n:
            if source[i] == "\\":
                i += 2
            elif source[i] == "`":
                return blank(a, i + 1)
            elif source.startswith("${", i):
                holes.append(0)
                return blank(a, i + 2)
            else:
                i += 1
        return blank(a, n)

    while at := special.search(source, i):
        i = at.start()
        c = source[i]
        if any(source.startswith(x, i) for x in syntax.line):
            end = source.find("\n", i)
            i = blank(i, n if end < 0 else end)
        elif start := next((x for x in syntax.block if source.startswith(x[0], i)), None):
            end = source.find(start[1], i + len(start[0]))
            i = blank(i, n if end < 0 else end + len(start[1]))
        elif mark := next((x for x in syntax.long if source.startswith(x, i)), None):
            end = source.find(mark, i + len(mark))
            i = after = blank(i, n if end < 0 else end + len(mark))
        elif c == "`" and syntax.template:
            blank(i, i + 1)
            i = after = template(i + 1)
        elif c in syntax.quotes:
            k = i + 1
            while k < n and source[k] not in (c, "\n"):
                k += 2 if source[k] == "\\" else 1
            i = after = blank(i, min(k + 1, n) if k < n and source[k] == c else k)
        elif c == "/" and syntax.regex and not operand(i):
            k, inside = i + 1, False
            while k < n and source[k] != "\n" and (inside or source[k] != "/"):
                inside = source[k] == "[" or inside and source[k] != "]"
                k += 2 if source[k] == "\\" else 1
            if k < n and source[k] == "/":
                i = after = blank(i, k + 1)
            else:
                i += 1
        elif holes and c == "}" and holes[-1] == 0:
            holes.pop()
            blank(i, i + 1)
            i = after = template(i + 1)
        else:
            if holes and c in "{}":
                holes[-1] += 1 if c == "{" else -1
            i += 1
    return "".join(out)


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    depth: int
    signature: str
    exported: bool
    doc: str | None = None
    indent: int = field(default=0, repr=False)


def _exported(language: str, line: str, name: str, parent: Symbol | None) -> bool:
    if parent and not parent.exported:
        return False
    if language in ("typescript", "javascript"):
        return not re.search(r"\bprivate\b|\bprotected\b", line) and not name.startswith("#") if parent else bool(re.match(r"\s*export\b", line))
    if language == "python":
        return not name.startswith("_") or name.startswith("__") and name.endswith("__")
    if language == "go":
        return name[:1].isupper()
    if language == "rust":
        return bool(re.match(r"\s*(pub\b|impl\b)", line)) or bool(parent and (parent.kind == "interface" or " for " in parent.signature))
    if language in ("java", "csharp"):
        return "public" in line or bool(parent and parent.kind == "interface")
    if language in ("kotlin", "swift", "php"):
        return not re.search(r"\b(private|protected|fileprivate)\b", line)
    return not name.startswith("_")


def _doc(raw: list[str], masked: list[str], at: int) -> str | None:
    """The first telling line of the comment right above a declaration; decorators may stand between."""
    found: list[str] = []
    for k in range(at - 1, max(-1, at - 13), -1):
        if not raw[k].strip():
            break
        if masked[k].strip():
            if raw[k].lstrip()[0] in "@#[":
                continue
            break
        found.append(raw[k].strip().strip("/*#!-\"' \t"))
    text = next((x for x in reversed(found) if len(x) > 2 and x.strip("=_")), None)
    return text and " ".join(text.split())[:DOC_MAX]


def _signature(head: str) -> str:
    return " ".join(head.split()).rstrip(" ;:,{")[:SIGNATURE_MAX]


def extract_symbols(source: str, language: str) -> list[Symbol]:
    """Declarations in order, with their extents, depth among each other and visibility."""
    raw = source.split("\n")
    if language == "markdown":
        found, open_, fenced = [], [], False
        for i, line in enumerate(raw, 1):
            mark = line.lstrip(" ")
            fenced ^= mark.startswith(("```", "~~~"))
            depth = len(mark) - len(mark.lstrip("#"))
            rest = mark[depth:]
            if fenced or not 1 <= depth <= 6 or len(line) - len(mark) > 3 or rest[:1] not in ("", " ", "\t"):
                continue
            # Number signs at the end count only after white space.
            name = rest.rstrip()
            bare = name.rstrip("#")
            name = bare.strip() if bare[-1:] in ("", " ", "\t") else name.strip()
            while open_ and open_[-1].depth >= depth - 1:
                open_.pop().end_line = i - 1
            found.append(Symbol(name, "heading", i, len(raw) - (raw[-1] == ""), depth - 1, line.strip(), True))
            open_.append(found[-1])
        return found[:SYMBOLS_MAX]
    if language in ("yaml", "toml"):
        key = re.compile(r"^([A-Za-z_][\w.-]*)\s*:" if language == "yaml" else r"^\[+([^\]]+)\]+")
        heads = [(i, m[1]) for i, line in enumerate(mask_source(source, language).split("\n"), 1) if (m := key.match(line))]
        return [Symbol(n, "property", i, (heads[k + 1][0] - 1 if k + 1 < len(heads) else len(raw)), 0, raw[i - 1].strip(), True) for k, (i, n) in enumerate(heads)][:SYMBOLS_MAX]
    if language in FLAT:
        lines = mask_source(source, language).split("\n")
        heads = [(i, said) for i, line in enumerate(lines, 1) if (said := grammar.flat(language, line))]
        last = max((k + 1 for k, x in enumerate(lines) if x.strip()), default=len(lines))
        ends = [*(i - 1 for i, _ in heads[1:]), last]
        return [Symbol(name, kind, i, max(i, end), 0, _signature(raw[i - 1]), _exported(language, raw[i - 1], name, None), _doc(raw, lines, i - 1)) for (i, (kind, name)), end in zip(heads, ends)][:SYMBOLS_MAX]
    if language not in grammar.GRAMMAR and language != "css":
        return []
    lines = mask_source(source, language).split("\n")
    found: list[Symbol] = []
    open_: list[tuple[Symbol, int]] = []
    by_indent, level, within = language in ("python", "ruby"), 0, 0
    for i, line in enumerate(lines):
        # What goes on inside brackets of an earlier line declares nothing.
        before, within = within, max(0, within + sum(line.count(c) for c in "([") - sum(line.count(c) for c in ")]"))
        if by_indent:
            if not line.strip():
                continue
            level = len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
            while open_ and level <= open_[-1][1] and not (language == "ruby" and line.strip() == "end" and level == open_[-1][1]):
                s, _ = open_.pop()
                s.end_line = next((k + 1 for k in range(i - 1, -1, -1) if lines[k].strip()), s.start_line)
        parent = open_[-1][0] if open_ else None
        # Bodies of functions are not searched, those of containers are.
        searched = level == 0 if parent is None else parent.kind in grammar.CONTAINERS and (by_indent or level == open_[-1][1] + 1)
        head = line
        for more in lines[i + 1 : i + 5]:  # a wrapped head is read as one line
            if head.count("(") <= head.count(")"):
                break
            head += " " + more
        said = grammar.declared(language, head, parent.kind if parent else None) if searched and not before else None
        if said and (by_indent or parent or level == 0):
            head, k = raw[i].strip(), i
            while not re.search(r"[{;:]\s*$|=>", lines[k]) and k + 1 < min(len(lines), i + 5) and head.count("(") > head.count(")"):
                k += 1
                head += " " + raw[k].strip()
            s = Symbol(said[1], said[0], i + 1, i + 1, len(open_), _signature(head), _exported(language, raw[i], said[1], parent), _doc(raw, lines, i))
            found.append(s)
            if by_indent and s.kind != "constant":
                open_.append((s, level))
            elif not by_indent:
                opens = next((j for j in range(i, min(len(lines), i + 40)) if "{" in lines[j] or ";" in lines[j]), None)
                if opens is not None and "{" in lines[opens] and ("{" in lines[i] or s.kind not in ("constant", "property")):
                    open_.append((s, level))
        if not by_indent:
            for c in re.findall("[{}]", line):
                if c == "{":
                    level += 1
                else:
                    level = max(0, level - 1)
                    if open_ and level == open_[-1][1]:
                        open_.pop()[0].end_line = i + 1
    if language in SCRIPT:
        for i, line in enumerate(raw):
            if lines[i].lstrip().startswith("export") and lines[i].split("export", 1)[1].lstrip()[:1] in ("*", "{", "t"):
                found += [Symbol(said, "module", i + 1, i + 1, 0, _signature(line), False) for said, _ in grammar.imported(language, line)]
        found.sort(key=lambda s: s.start_line)
    for s, _ in open_:
        s.end_line = max(s.start_line, len(lines) - (lines[-1].strip() == ""))
    return found[:SYMBOLS_MAX]


def extract_imports(source: str, language: str) -> list[tuple[str, int, list[str]]]:
    """(specifier, first line, local names), once for each specifier; lines that are comments or strings are skipped."""
    found: dict[str, tuple[int, list[str]]] = {}
    block = False
    for i, (line, plain) in enumerate(zip(source.split("\n"), mask_source(source, language).split("\n"), strict=True), 1):
        if language == "go":
            bare = plain.split()
            if bare[:1] == [")"]:
                block = False
            if not block and bare[:1] not in (["import"], ["import("]):
                continue
            block |= "import(" in "".join(bare)
        elif not plain.strip():
            continue
        for specifier, names in grammar.imported(language, line):
            at = found.setdefault(specifier, (i, []))
            at[1].extend(x for x in names if x not in at[1])
    return [(k, i, names) for k, (i, names) in found.items()][:IMPORTS_MAX]


def listed_exports(source: str) -> list[str]:
    """Names that `export { .. }` lists give to the outside, wherever they stand."""
    names = []
    for after in source.split("export")[1:]:
        inner = after.lstrip().removeprefix("type").lstrip()
        if inner.startswith("{") and "}" in inner:
            parts = (x.split() for x in inner[1 : inner.index("}")].split(","))
            names += [p[-1] for p in parts if p and re.fullmatch(r"[\w$]+", p[-1])]
    return names


SCHEMA = """path string, language string, line_count int, symbols array<struct<name:string,kind:string,start_line:int,end_line:int,depth:int,signature:string,exported:boolean,doc:string>>,
imports array<struct<specifier:string,line:int,names:array<string>>>, exports array<string>"""


def parse(path: str, content: str) -> dict:
    language = detect_language(path)
    symbols = extract_symbols(content, language)
    exports = [s.name for s in symbols if s.exported and s.depth == 0]
    if language in SCRIPT:
        exports += listed_exports(content)
    return {
        "path": path, "language": language, "line_count": content.count("\n") + (content != "" and not content.endswith("\n")), "exports": list(dict.fromkeys(exports)),
        "symbols": [{k: getattr(s, k) for k in ("name", "kind", "start_line", "end_line", "depth", "signature", "exported", "doc")} for s in symbols],
        "imports": [{"specifier": a, "line": b, "names": c} for a, b, c in extract_imports(content, language)],
    }


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame([parse(p, c or "") for p, c in zip(f["path"], f["content"], strict=True)], columns=["path", "language", "line_count", "symbols", "imports", "exports"])


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, content) to a nested row each. A map: nothing moves between tasks."""
    return spread(files.select("path", "content"), "path").mapInPandas(_parsed, SCHEMA)
