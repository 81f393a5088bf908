"""Declarations and imports of each language, with expectations written by hand."""

import pytest

from loomlens.operators import grammar, parse

IMPORTS = [
    ("typescript", 'import type { Knob, Dial as Wheel } from "./panel";', [("./panel", ["Knob", "Wheel"])]),
    ("typescript", "import Lamp, * as shades from '../lights.js'", [("../lights.js", ["Lamp", "shades"])]),
    ("typescript", 'import "./side-effect.css";', [("./side-effect.css", [])]),
    ("javascript", 'const a = require("./a"), b = await import("./b");', [("./a", []), ("./b", [])]),
    ("javascript", 'export * from "./all";', [("./all", ["*"])]),
    ("javascript", "export const important = 'no';", []),
    ("python", "import os, numpy.linalg as la  # both", [("os", ["os"]), ("numpy.linalg", ["la"])]),
    ("python", "from ..shop import (basket as b, till)", [("..shop", ["b", "till"])]),
    ("python", "from . import sibling", [(".", ["sibling"])]),
    ("go", 'import alias "host.test/pkg"', [("host.test/pkg", [])]),
    ("rust", "pub use crate::deck::{card, pile::{top, bottom as low}, self};", [("crate::deck::card", ["card"]), ("crate::deck::pile::top", ["top"]), ("crate::deck::pile::bottom", ["low"]), ("crate::deck", ["self"])]),
    ("rust", "mod inner;", [("inner", ["inner"])]),
    ("rust", "mod inner {", []),
    ("java", "import static org.sample.Tool.run;", [("org.sample.Tool.run", ["run"])]),
    ("kotlin", "import org.sample.Thing as Other", [("org.sample.Thing", ["Other"])]),
    ("csharp", "using Short = Long.Name.Space;", [("Long.Name.Space", ["Short"])]),
    ("csharp", "using (var x = Open()) {", []),
    ("swift", "import Foundation", [("Foundation", ["Foundation"])]),
    ("c", "#include <sys/stat.h>", [("sys/stat.h", [])]),
    ("cpp", '#include "shape.hpp"', [("shape.hpp", [])]),
    ("ruby", "require_relative 'lib/cart'", [("lib/cart", [])]),
    ("php", "use App\\Shop\\{Cart, Till as Desk};", [("App\\Shop\\Cart", ["Cart"]), ("App\\Shop\\Till", ["Desk"])]),
    ("php", "require_once('boot.php');", [("boot.php", [])]),
    ("css", '@import url("base.css");', [("base.css", [])]),
    ("shell", ". ./env.sh", [("./env.sh", [])]),
    ("shell", "source lib.sh", [("lib.sh", [])]),
]


@pytest.mark.parametrize("language,line,want", IMPORTS)
def test_imports(language, line, want):
    got = grammar.imported(language, line)
    if line.startswith("export *"):
        assert [x for x, _ in got] == [x for x, _ in want]
    else:
        assert got == want


DECLARED = [
    ("typescript", "export default async function go<T>(x: T) {", None, ("function", "go")),
    ("typescript", "export const run = async (x) => {", None, ("function", "run")),
    ("typescript", "const limit = 3;", None, ("constant", "limit")),
    ("typescript", "  static async find(id: string): Promise<X> {", "class", ("method", "find")),
    ("typescript", "  readonly size: number;", "class", ("property", "size")),
    ("typescript", "  if (x) {", "class", None),
    ("typescript", "type Pair<A> = [A, A];", None, ("type", "Pair")),
    ("typescript", "class.call(this);", None, None),
    ("python", "async def fetch(url):", None, ("function", "fetch")),
    ("python", "    def fetch(self):", "class", ("method", "fetch")),
    ("python", "LIMIT: int = 4", None, ("constant", "LIMIT")),
    ("go", "func (s *Store[K]) Put(k K) error {", None, ("method", "Put")),
    ("go", "type Shape interface {", None, ("interface", "Shape")),
    ("go", "type Celsius float64", None, ("type", "Celsius")),
    ("rust", "pub(crate) async unsafe fn step<'a>() {", None, ("function", "step")),
    ("rust", "impl<T> Draw for Canvas<T> {", None, ("class", "Canvas")),
    ("java", "    public static List<String> names(int n) {", "class", ("method", "names")),
    ("java", "@Override", "class", None),
    ("java", "    return make(n) {", "class", None),
    ("java", "public record Point(int x, int y) {", None, ("class", "Point")),
    ("kotlin", "suspend fun <T> List<T>.second(): T {", None, ("function", "second")),
    ("kotlin", "data class User(val id: Int)", None, ("class", "User")),
    ("kotlin", "enum class Suit {", None, ("class", "Suit")),
    ("swift", "public extension Array {", None, ("class", "Array")),
    ("swift", "    mutating func push(_ x: Int) {", "struct", ("method", "push")),
    ("csharp", "namespace Shop.Core;", None, ("module", "Shop.Core")),
    ("csharp", "    protected override async Task<int> Run(int n)", "class", ("method", "Run")),
    ("c", "static int add(int a, int b) {", None, ("function", "add")),
    ("c", "#define LIMIT 3", None, ("constant", "LIMIT")),
    ("c", "add(a, b);", None, None),
    ("cpp", "template <typename T> class Box {", None, ("class", "Box")),
    ("cpp", "void Box::open() {", None, ("function", "Box::open")),
    ("ruby", "  def self.empty?", "class", ("method", "empty?")),
    ("ruby", "module Shop::Core", None, ("module", "Shop::Core")),
    ("php", "abstract class Cart {", None, ("class", "Cart")),
    ("php", "    public static function open($x) {", "class", ("method", "open")),
    ("css", ".card > .title {", None, ("type", ".card > .title")),
]


@pytest.mark.parametrize("language,line,inside,want", DECLARED)
def test_declarations(language, line, inside, want):
    assert grammar.declared(language, line, inside) == want


def test_flat_extents():
    sql = "-- a table\nCREATE TABLE IF NOT EXISTS shop.till (\n  id INT\n);\ncreate or replace function f() returns int\nas $$ select 1 $$;\n"
    got = [(s.name, s.kind, s.start_line, s.end_line) for s in parse.extract_symbols(sql, "sql")]
    assert got == [("shop.till", "type", 2, 4), ("f", "function", 5, 6)]
    got = [(s.name, s.start_line, s.end_line) for s in parse.extract_symbols("a() {\n  x\n}\n\nfunction b-c {\n}\n", "shell")]
    assert got == [("a", 1, 4), ("b-c", 5, 6)]


def test_file_names():
    want = {"a.jsonc": "json", "x/App.vue": "html", "y.svelte": "html", ".bashrc": "shell", "Cargo.toml": "toml", "go.mod": "text", "Dockerfile": "shell", ".env": "text", "b.TSX": "typescript"}
    assert {p: parse.detect_language(p) for p in want} == want
