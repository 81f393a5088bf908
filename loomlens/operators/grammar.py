"""What single lines of source declare and import, read token by token with a table of words for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

#: A quoted text, a name, an arrow or path sign, any other sign.
_TOKEN = re.compile(r"""("[^"]*"|'[^']*'|`[^`]*`)|([#@]?[^\W\d][\w$]*|\$\w+|\d[\w.]*)|(=>|::|->|\.\.\.|\S)""")
#: The same where texts are blanked: a quote is a sign, as before a lifetime.
_MASKED = re.compile(r"""()([#@]?[^\W\d][\w$]*|\$\w+|\d[\w.]*)|(=>|::|->|\.\.\.|\S)""")
CONTAINERS = frozenset(("class", "interface", "enum", "module", "struct", "type"))


@dataclass(frozen=True)
class Words:
    """kinds: what a word declares; before: words that may precede it; values: words that declare a constant at the top
    level; loose: members are declared by a bare name and its signs; typed: functions by a type, a name and brackets."""

    kinds: dict[str, str]
    before: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()
    loose: bool = False
    typed: bool = False


def _words(kinds: str, before: str = "", values: str = "", **how) -> Words:
    return Words({w: kind for kind, _, ws in (k.partition("=") for k in kinds.split()) for w in ws.split(",")}, frozenset(before.split()), frozenset(values.split()), **how)


_JS = _words("class=class interface=interface enum=enum type=type module=namespace function=function", "export default declare abstract async public private protected static readonly override get set", "const let var", loose=True)
_C = _words("struct=struct,union class=class enum=enum module=namespace constant=#define", "typedef static inline extern virtual constexpr explicit unsigned", typed=True)
GRAMMAR = {
    "typescript": _JS,
    "javascript": _JS,
    "python": _words("class=class function=def", "async"),
    "go": _words("function=func type=type", values="const var"),
    "rust": _words("function=fn struct=struct,union enum=enum interface=trait class=impl module=mod type=type", "pub async unsafe extern default", "const static"),
    "java": _words("class=class,record interface=interface enum=enum", "public private protected static final abstract sealed default synchronized native strictfp", typed=True),
    "kotlin": _words("class=class,object interface=interface function=fun type=typealias", "public private protected internal open abstract sealed data override inline suspend operator infix tailrec lateinit enum annotation companion", "val var"),
    "swift": _words("class=class,actor,extension struct=struct enum=enum interface=protocol function=func type=typealias", "public private internal fileprivate open final static override mutating indirect", "let var"),
    "csharp": _words("class=class,record struct=struct enum=enum interface=interface module=namespace", "public private protected internal static sealed abstract partial readonly virtual override async unsafe extern new", typed=True),
    "c": _C,
    "cpp": _C,
    "ruby": _words("class=class module=module function=def"),
    "php": _words("class=class,trait interface=interface enum=enum function=function constant=const", "public private protected static final abstract readonly"),
}
#: Names that a call or a statement begins with, which declare nothing.
RESERVED = frozenset("if for while switch catch return else do try with function new typeof await super elif case when until throw using lock foreach sizeof".split())


def _tokens(line: str, masked: bool = False) -> list[str]:
    return [m[0] for m in (_MASKED if masked else _TOKEN).finditer(line)]


def _name(x: str) -> bool:
    return bool(re.match(r"#?[^\W\d]", x))


def _closing(tokens: list[str], i: int, pair: str) -> int:
    """The place after the bracket that closes the one at i, or the end."""
    depth = 0
    for k in range(i, len(tokens)):
        depth += (tokens[k] == pair[0]) - (tokens[k] == pair[1])
        if not depth:
            return k + 1
    return len(tokens)


def declared(language: str, line: str, inside: str | None) -> tuple[str, str] | None:
    """(kind, name) of what a masked line declares at the top level, or in a container of kind `inside`."""
    if language == "css":
        head, brace, _ = line.partition("{")
        return ("type", head.strip()) if brace and re.match(r"\s*[.#@\w:*&]", head) else None
    words, tokens = GRAMMAR[language], _tokens(line, True)
    i = 0
    while i < len(tokens):
        if tokens[i].startswith("@") or tokens[i] == "template":
            i += 1
        elif tokens[i] in words.before and not (words.loose and i + 1 < len(tokens) and tokens[i + 1] in "(=:;?"):
            i += 1
        elif i and tokens[i] in "(<" and tokens[i - 1] not in words.kinds:  # pub(crate), @name(...), template<...>
            i = _closing(tokens, i, {"(": "()", "<": "<>"}[tokens[i]])
        elif i == 0 and tokens[i] == "[" and language == "csharp":
            i = _closing(tokens, i, "[]")
        elif tokens[i] == "#" and language == "rust":
            return None
        else:
            break
    rest = tokens[i:]
    if not rest:
        return None
    kind = words.kinds.get(rest[0])
    if kind and (len(rest) < 2 or rest[1] in (":", "=", ".", ",", ")", ";") or inside and words.loose and rest[1] == "("):
        kind = None
    if kind:
        found = _named(language, kind, rest)
        if found and inside in CONTAINERS and inside != "module" and found[0] == "function":
            return "method", found[1]
        return found
    if rest[0] in words.values and len(rest) > 1 and not inside:
        at = 2 if rest[1] in ("mut", "enum") and len(rest) > 2 else 1
        if not _name(rest[at]):
            return None
        return ("function" if words.loose and _calls(rest[at + 1 :]) else "constant"), rest[at]
    if language in ("python", "ruby") and not inside and len(rest) > 1 and re.fullmatch(r"[A-Z][A-Z0-9_]*", rest[0]) and not line[:1].isspace():
        sets = rest.index("=") if "=" in rest else 0
        return ("constant", rest[0]) if sets == 1 and rest[2:3] != ["="] or rest[1] == ":" and language == "python" else None
    if words.loose and inside in CONTAINERS:
        return _member(rest)
    if words.typed and "(" in rest and rest[-1] not in (";", ","):
        at = rest.index("(") - 1
        # A name, with a type before it unless a container holds it.
        if at >= (0 if inside in CONTAINERS else 1) and _name(rest[at]) and rest[at] not in RESERVED and not RESERVED & set(rest[:at]) and not {"=", ".", "("} & set(rest[:at]) and (rest[-1] in "{)" or rest[-1] == "const"):
            name = "::".join([*(x for x in rest[:at][-2:-1] if at > 1 and rest[at - 1] == "::"), rest[at]])
            return ("method" if inside in CONTAINERS and inside != "module" else "function"), name
    return None


def _named(language: str, kind: str, rest: list[str]) -> tuple[str, str] | None:
    """What the word rest[0] declares: the name after it, past signs, types and receivers."""
    i = 1
    if language == "go" and rest[0] == "func" and rest[1] == "(":
        i, kind = _closing(rest, 1, "()"), "method"
    if rest[0] == "impl" and language == "rust":
        if rest[1] == "<":
            i = _closing(rest, 1, "<>")
        if "for" in rest[i:]:
            i = rest.index("for", i) + 1
    while i < len(rest) and (rest[i] in ("*", "&", "class", "enum") or rest[i] == "<"):
        i = _closing(rest, i, "<>") if rest[i] == "<" else i + 1
    if i >= len(rest) or not _name(rest[i]) or rest[i] in RESERVED:
        return None
    if language == "ruby":
        i += 2 if rest[i : i + 2] == ["self", "."] else 0
        if i < len(rest) and kind == "function":
            return kind, rest[i] + (rest[i + 1] if rest[i + 1 : i + 2] in (["?"], ["!"], ["="]) else "")
        return kind, _dotted(rest[i:], ("::",))[0]
    name = rest[i]
    while kind == "module" and rest[i + 1 : i + 2] in (["."], ["::"]) and i + 2 < len(rest):
        name, i = name + rest[i + 1] + rest[i + 2], i + 2
    if language == "kotlin" and kind == "function":  # a receiver may stand before the name
        head = rest[: rest.index("(")] if "(" in rest[i:] else rest
        name = next((x for x in reversed(head) if _name(x)), name)
    if language == "go" and kind == "type" and i + 1 < len(rest):
        kind = rest[i + 1] if rest[i + 1] in ("struct", "interface") else kind
    return kind, name


def _calls(rest: list[str]) -> bool:
    """Whether what follows a name makes it a function: an arrow, or the word itself, after the sign that sets it."""
    if "=" not in rest:
        return False
    after = rest[rest.index("=") + 1 :]
    after = after[1:] if after[:1] == ["async"] else after
    return after[:1] == ["function"] or after[:1] == ["("] and "=>" in after or len(after) > 1 and _name(after[0]) and after[1] == "=>"


def _member(rest: list[str]) -> tuple[str, str] | None:
    i = 1 if rest[0] == "*" else 0
    if i >= len(rest) or not _name(rest[i]) or rest[i] in RESERVED:
        return None
    name, after = rest[i], rest[i + 1 :]
    if after[:1] == ["<"]:
        after = after[_closing(after, 0, "<>") :]
    if after[:1] == ["("]:
        tail = after[_closing(after, 0, "()") :]
        return ("method", name) if tail and tail[0] in "{:;" else None
    after = after[1:] if after[:1] in (["?"], ["!"]) else after
    if _calls(after):
        return "method", name
    return ("property", name) if after[:1] in ([":"], ["="], [";"]) else None


#: Flat languages: a declaration reaches to the next.
def flat(language: str, line: str) -> tuple[str, str] | None:
    tokens = _tokens(line)
    low = [t.lower() for t in tokens]
    if language == "shell":
        if low[:1] == ["function"] and len(tokens) > 1:
            return "function", re.match(r"\s*function\s+([^\s(]+)", line)[1]
        head = re.match(r"\s*([^\s()=$]+)\s*\(\s*\)", line)
        return ("function", head[1]) if head else None
    if low[:1] != ["create"]:
        return None
    kinds = {"function": "function", "procedure": "function", "trigger": "function", "table": "type", "view": "type", "index": "type", "type": "type", "schema": "module"}
    at = next((k for k, t in enumerate(low[:6]) if t in kinds), None)
    if at is None:
        return None
    rest = tokens[at + 1 :]
    if [t.lower() for t in rest[:3]] == ["if", "not", "exists"]:
        rest = rest[3:]
    name = ""
    for t in rest:
        if not (_name(t) or t == "." or t[:1] in "\"`") or name and t != "." and not name.endswith("."):
            break
        name += t.strip('"`')
    return (kinds[low[at]], name) if name else None


def _text(x: str) -> str | None:
    return x[1:-1] if len(x) > 1 and x[0] in "\"'`" and x[-1] == x[0] else None


def _local(parts: list[str]) -> str:
    """The name that `a as b`, or a, has here."""
    return parts[parts.index("as") + 1] if "as" in parts[:-1] else parts[0] if parts else ""


def _split(tokens: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    for t in [*tokens, ","]:
        if t == ",":
            yield part
            part = []
        else:
            part.append(t)


def _dotted(tokens: list[str], signs: tuple[str, ...]) -> tuple[str, int]:
    """A path of names and signs from the beginning, and how many tokens it has."""
    n = 0
    while n < len(tokens) and (tokens[n] in signs or _name(tokens[n]) and (n == 0 or tokens[n - 1] in signs)):
        n += 1
    return "".join(tokens[:n]), n


def _groups(tokens: list[str], signs: tuple[str, ...], join: str) -> Iterator[tuple[str, str]]:
    """(path, local name) of each leaf of a path with groups in braces: a::{b, c::{d, e}}."""
    for part in _grouped(tokens):
        path, n = _dotted(part, signs)
        if part[n : n + 1] == ["{"]:
            for inner, name in _groups(part[n + 1 : _closing(part, n, "{}") - 1], signs, join):
                yield (path.removesuffix(join) if inner == "self" else path.removesuffix(join) + join + inner), name
        elif path:
            leaf = path.removesuffix(join)
            yield leaf, part[n + 1] if part[n : n + 1] == ["as"] and n + 1 < len(part) else leaf.rpartition(join)[2]


def _grouped(tokens: list[str]) -> Iterator[list[str]]:
    part, depth = [], 0
    for t in tokens:
        depth += (t == "{") - (t == "}")
        if t == "," and not depth:
            yield part
            part = []
        else:
            part.append(t)
    yield part


def imported(language: str, line: str) -> list[tuple[str, list[str]]]:
    """(specifier, local names) of what a line imports. Go's blocks are for the caller: here a line holds what is in one."""
    t = _tokens(line)
    if not t:
        return []
    first, rest = t[0], t[1:]
    if language in ("typescript", "javascript"):
        if first in ("import", "export") and rest[:1] != ["("]:
            at = next((k for k, x in enumerate(rest) if _text(x) is not None), None)
            if at is None or at and rest[at - 1] != "from":
                return [] if at is None else [x for k in range(len(t) - 2) if (x := _called(t, k))]
            clause = [x for x in rest[: max(0, at - 1)] if x not in "{}"]
            clause = clause[1:] if clause[:1] == ["type"] and clause[1:2] != [","] else clause
            names = [_local(p[1:] if p[:1] == ["type"] and len(p) > 1 and p[1] != "as" else p) for p in _split(clause)]
            return [(_text(rest[at]), [n for n in names if n and _name(n)])]
        return [x for k in range(len(t) - 2) if (x := _called(t, k))]
    if language == "python":
        if first == "import":
            parts = [p for p in _split(rest[: rest.index("#")] if "#" in rest else rest) if p]
            return [(path, [_local(p[n - 1 :]) if "as" in p else path.partition(".")[0]]) for p in parts for path, n in [_dotted(p, (".",))] if path]
        if first == "from" and "import" in rest:
            at = rest.index("import")
            tail = [x for x in rest[at + 1 :] if x not in "()\\"]
            tail = tail[: tail.index("#")] if "#" in tail else tail
            return [("".join(rest[:at]).replace("...", "..."), [n for p in _split(tail) if (n := _local(p)) and _name(n)])]
        return []
    if language == "go":
        at = next((k for k, x in enumerate(t) if _text(x) is not None), None)
        return [] if at is None or at > 2 else [(_text(t[at]), [])]
    if language == "rust":
        while t and (t[0] == "pub" or t[0] == "("):
            t = t[_closing(t, 0, "()") :] if t[0] == "(" else t[1:]
        if t[:1] == ["use"]:
            return [(path, [name]) for path, name in _groups(t[1 : t.index(";") if ";" in t else len(t)], ("::", "*"), "::")]
        return [(t[1], [t[1]])] if t[:1] == ["mod"] and t[2:3] == [";"] else []
    if language in ("java", "kotlin", "swift", "csharp"):
        if first not in ("import", "using", "global") or language == "csharp" and "(" in t:
            return []
        rest = [x for x in t if x not in ("import", "using", "global", "static")]
        alias = rest[0] if rest[1:2] == ["="] else None
        path, n = _dotted(rest[2:] if alias else rest, (".", "*"))
        return [(path.removesuffix("."), [alias or _local([path.rstrip(".*").rpartition(".")[2], *rest[n:]])])] if path else []
    if language in ("c", "cpp"):
        if first not in ("#include", "#import") and t[:2] not in (["#", "include"], ["#", "import"]):
            return []
        quoted = next((x for x in t if _text(x) is not None), None)
        return [(_text(quoted), [])] if quoted else [(line.partition("<")[2].partition(">")[0], [])] if "<" in line else []
    if language in ("ruby", "shell", "css", "php"):
        asks = {"ruby": ("require", "require_relative", "load"), "css": ("@import", "@use", "@forward"), "php": ("require", "require_once", "include", "include_once"), "shell": ("source", ".")}[language]
        if language == "php" and first == "use":
            return [(path, [name]) for path, name in _groups([x for x in rest if x not in ("function", "const", ";")], ("\\",), "\\")]
        if first not in asks:
            return []
        said = next((x for x in rest if _text(x) is not None), None)
        if said is not None:
            return [(_text(said), [])]
        return [(line.split()[1], [])] if language == "shell" and len(line.split()) > 1 else []
    return []


def _called(t: list[str], k: int) -> tuple[str, list[str]] | None:
    """A module named in a call: require("x"), import("x")."""
    said = _text(t[k + 2]) if t[k] in ("require", "import") and t[k + 1] == "(" and (k == 0 or t[k - 1] != ".") else None
    return None if said is None else (said, [])
