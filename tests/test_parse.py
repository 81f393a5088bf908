"""The parse stage, ignore rules and the workspace source on fixtures of our own."""

import random

import pytest

from loomlens.operators import parse
from loomlens.sources import workspace

TS = '''/** A shelf of things. */
export class Shelf {
  private size = 0;
  constructor(private readonly name: string) {
    const hidden = () => 1;
  }
  put(item: string): void {
    if (item) { this.size += 1; }
  }
}

export const make = (n: string) => {
  return new Shelf(n);
};
const LIMIT = [
  1,
];
export interface Box { id: number }
// class NotMe {}
const text = `class ${make("x { ")} Nor {`;
export { LIMIT as limit };
import { put as place, take } from "./hands.js";
'''
PY = '''class A(object):
    """class Hidden: pass"""

    def first(self):
        def inner():
            return 1
        return inner

    def __repr__(self):
        return "def no(): pass"


def _private():
    pass

LIMIT = 3
from .pkg import one as uno, two
'''


def named(source, language):
    return {s.name: s for s in parse.extract_symbols(source, language)}


def test_typescript():
    s = named(TS, "typescript")
    assert (s["Shelf"].kind, s["Shelf"].start_line, s["Shelf"].end_line, s["Shelf"].exported, s["Shelf"].doc) == ("class", 2, 10, True, "A shelf of things.")
    assert (s["put"].kind, s["put"].depth, s["put"].start_line, s["put"].end_line) == ("method", 1, 7, 9)
    assert not s["size"].exported and "hidden" not in s and "NotMe" not in s and "Nor" not in s
    assert (s["make"].kind, s["make"].end_line) == ("function", 14)
    assert s["LIMIT"].kind == "constant" and not s["LIMIT"].exported and s["Box"].kind == "interface"
    p = parse.parse("src/shelf.ts", TS)
    assert p["exports"] == ["Shelf", "make", "Box", "limit"]
    assert p["imports"] == [{"specifier": "./hands.js", "line": 22, "names": ["place", "take"]}]


def test_python():
    s = named(PY, "python")
    assert (s["A"].end_line, s["first"].kind, s["first"].end_line, s["__repr__"].exported, s["_private"].exported) == (10, "method", 7, True, False)
    assert "Hidden" not in s and "no" not in s and s["LIMIT"].kind == "constant"
    assert parse.extract_imports(PY, "python") == [(".pkg", 17, ["uno", "two"])]


def test_other_languages():
    go = named("package x\n\nfunc (s *Server) Run() {\n}\n\nfunc help() {\n}\ntype Thing struct {\n}\n", "go")
    assert (go["Run"].kind, go["Run"].exported, go["help"].exported, go["Thing"].kind) == ("method", True, False, "struct")
    rust = named("pub trait T {\n    fn a(&self);\n}\nimpl T for S {\n    pub fn b(&self) {\n    }\n}\n", "rust")
    assert (rust["T"].kind, rust["b"].kind, rust["T"].end_line) == ("interface", "method", 3)
    md = parse.extract_symbols("# One\ntext\n## Two\n```\n# no\n```\n# Three\n", "markdown")
    assert [(x.name, x.start_line, x.end_line) for x in md] == [("One", 1, 6), ("Two", 3, 6), ("Three", 7, 7)]
    assert parse.extract_imports('import (\n\t"fmt"\n\tx "a/b"\n)\n', "go") == [("fmt", 2, []), ("a/b", 3, [])]
    assert parse.extract_symbols("", "typescript") == [] and parse.extract_symbols("x", "text") == []
    assert [parse.detect_language(p) for p in ("a/b.TS", "Makefile", ".gitignore", "x", "y.rs")] == ["typescript", "shell", "text", "text", "rust"]


@pytest.mark.parametrize("language", ["typescript", "python", "go", "rust", "sql"])
def test_masks_keep_the_shape(language):
    rng = random.Random(language)
    for _ in range(300):
        s = "".join(rng.choice(["a", '"', "'", "`", "${", "}", "{", "/", "*", "//", "/*", "*/", "#", "\n", "\\", '"""', " ", "--"]) for _ in range(40))
        m = parse.mask_source(s, language)
        assert len(m) == len(s) and [i for i, c in enumerate(m) if c == "\n"] == [i for i, c in enumerate(s) if c == "\n"]
    assert parse.mask_source("x = /a[/]b/.test(y) / 2 // c", "javascript").split() == ["x", "=", ".test(y)", "/", "2"]


def test_ignore_rules():
    """Each rule by itself, then together: the last that fits decides."""
    ig = workspace.Ignore().add("cache/\n*.bak\n/top.md\nout\n!spare.bak\nart/**/*.psd\n# remark\n\\#real\n").add("own.key", "apps/till")
    for path, want in {
        "cache/": True, "x/y/cache/": True, "cache": False, "cache/deep/er.txt": True, "x/z.bak": True, "spare.bak": False, "top.md": True, "x/top.md": False, "out/a/b.c": True, "lib/out.c": False,
        "art/a.psd": True, "art/x/y/b.psd": True, "x/a.psd": False, "apps/till/own.key": True, "apps/desk/own.key": False, "#real": True, "# remark": False,
    }.items():
        assert ig.ignores(path.rstrip("/"), path.endswith("/")) is want, path
    assert workspace.compile_rule("# remark") is None and workspace.compile_rule(" \t") is None


def test_workspace(spark, tmp_path):
    for path, text in {".gitignore": "dist/\n*.log", "src/a.ts": "export const a = 1;\n", "dist/x.ts": "no", "b.log": "no", "src/.hidden": "yes", "bin.dat": "a\0b"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "link").symlink_to(tmp_path / "src")
    spark.dataSource.register(workspace.Workspace)
    files = spark.read.format("workspace").load(str(tmp_path))
    assert {r.path: r.content is None for r in files.collect()} == {".gitignore": False, "src/a.ts": False, "src/.hidden": False, "bin.dat": True}
    got = parse.parse_files(files.where("content is not null and path like 'src/%.ts'")).collect()
    assert [(r.path, r.exports, r.line_count) for r in got] == [("src/a.ts", ["a"], 1)]
    assert workspace.contained(str(tmp_path), "src/../src/a.ts") == "src/a.ts"
    with pytest.raises(workspace.PathEscape):
        workspace.contained(str(tmp_path), "../x")
