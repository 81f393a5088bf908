"""What the queries of tree_fixture.py must return: columns with their SQL types, and rows, each read over against the fixture."""

# fmt: off
ANSWERS: dict[str, tuple[dict[str, str], list[tuple]]] = {
    'tree_symbols': (
        {'path': 'VARCHAR', 'name': 'VARCHAR', 'kind': 'VARCHAR', 'start_line': 'BIGINT', 'end_line': 'BIGINT', 'depth': 'BIGINT', 'exported': 'BOOLEAN', 'doc': 'VARCHAR', 'signature': 'VARCHAR'},
        [
            ('README.md', 'Beds', 'heading', 5, 12, 1, True, None, '## Beds'),
            ('README.md', 'Garden', 'heading', 1, 13, 0, True, None, '# Garden'),
            ('README.md', 'Soil', 'heading', 11, 12, 2, True, None, '### Soil'),
            ('README.md', 'Tools', 'heading', 13, 13, 1, True, None, '## Tools'),
            ('bin/run.sh', 'start', 'function', 3, 6, 0, True, None, 'start()'),
            ('bin/run.sh', 'stop', 'function', 7, 9, 0, True, None, 'function stop'),
            ('conf/app.toml', 'beds', 'property', 1, 3, 0, True, None, '[beds]'),
            ('conf/app.toml', 'rows', 'property', 4, 6, 0, True, None, '[[rows]]'),
            ('conf/app.yaml', 'beds', 'property', 3, 4, 0, True, None, 'beds:'),
            ('conf/app.yaml', 'end', 'property', 5, 6, 0, True, None, 'end: 2'),
            ('conf/app.yaml', 'name', 'property', 1, 2, 0, True, None, 'name: garden'),
            ('db/schema.sql', 'beds', 'type', 2, 6, 0, True, 'Beds.', 'CREATE TABLE IF NOT EXISTS beds ('),
            ('db/schema.sql', 'rows', 'type', 7, 8, 0, True, None, 'create or replace view rows as'),
            ('java/org/garden/App.java', 'App', 'class', 6, 15, 0, True, None, 'public class App'),
            ('java/org/garden/App.java', 'hidden', 'method', 12, 14, 1, False, None, 'private int hidden(int n)'),
            ('java/org/garden/App.java', 'run', 'method', 8, 10, 1, True, 'Runs.', 'public static List<String> run(int n)'),
            ('java/org/garden/util/Names.java', 'Names', 'interface', 3, 4, 0, True, None, 'public interface Names'),
            ('jobs/run.py', 'Job', 'class', 5, 18, 0, True, None, 'class Job(Shelf)'),
            ('jobs/run.py', 'RETRIES', 'constant', 26, 26, 0, True, None, 'RETRIES = 4'),
            ('jobs/run.py', '_secret', 'method', 17, 18, 1, False, None, 'def _secret(self)'),
            ('jobs/run.py', 'main', 'function', 21, 23, 0, True, None, 'async def main(argv)'),
            ('jobs/run.py', 'start', 'method', 10, 14, 1, True, None, 'def start(self)'),
            ('jobs/store.py', 'Shelf', 'class', 1, 2, 0, True, None, 'class Shelf'),
            ('jobs/store.py', 'shelf_of', 'function', 5, 5, 0, True, None, 'def shelf_of(x): return x'),
            ('lib/src/bed.rs', 'Row', 'struct', 1, 1, 0, True, None, 'pub struct Row'),
            ('lib/src/bed.rs', 'Thing', 'struct', 4, 4, 1, True, None, 'pub struct Thing'),
            ('lib/src/bed.rs', 'deep', 'module', 3, 5, 0, True, None, 'pub mod deep'),
            ('lib/src/lib.rs', 'Grow', 'interface', 5, 7, 0, True, None, 'pub trait Grow'),
            ('lib/src/lib.rs', 'Plot', 'class', 11, 15, 0, True, None, "impl<'a> Grow for Plot<'a>"),
            ('lib/src/lib.rs', 'Plot', 'struct', 9, 9, 0, True, None, "pub struct Plot<'a> { name: &'a str }"),
            ('lib/src/lib.rs', 'bed', 'module', 1, 1, 0, False, None, 'mod bed'),
            ('lib/src/lib.rs', 'grow', 'method', 12, 14, 1, True, None, 'fn grow(&self)'),
            ('lib/src/lib.rs', 'grow', 'method', 6, 6, 1, True, None, 'fn grow(&self)'),
            ('packages/core/src/bed.ts', '#water', 'method', 26, 26, 1, False, None, '#water() {}'),
            ('packages/core/src/bed.ts', 'Bed', 'class', 8, 27, 0, True, 'A bed of plants.', 'export class Bed extends Soil'),
            ('packages/core/src/bed.ts', 'LIMIT', 'constant', 33, 33, 0, False, None, 'const LIMIT = [1, 2]'),
            ('packages/core/src/bed.ts', 'Row', 'type', 35, 35, 0, True, None, 'export type Row = { id: number }'),
            ('packages/core/src/bed.ts', 'constructor', 'method', 11, 13, 1, True, None, 'constructor(readonly name: string)'),
            ('packages/core/src/bed.ts', 'pattern', 'constant', 34, 34, 0, False, None, 'const pattern = /class [Nope] {/g, text = `function ${plant("x")} no() {`'),
            ('packages/core/src/bed.ts', 'plant', 'function', 29, 32, 0, True, None, 'export const plant = async (name: string) =>'),
            ('packages/core/src/bed.ts', 'put', 'method', 16, 24, 1, True, 'Puts a plant in.', 'async put( plant: string, depth = 3, ): Promise<void>'),
            ('packages/core/src/bed.ts', 'rows', 'property', 9, 9, 1, False, None, 'private rows = 0'),
            ('packages/core/src/index.ts', './bed.js', 'module', 1, 1, 0, False, None, 'export { Bed, plant as sow } from "./bed.js"'),
            ('packages/core/src/index.ts', './soil', 'module', 2, 2, 0, False, None, 'export * from "./soil"'),
            ('packages/core/src/soil.ts', 'Grain', 'interface', 1, 3, 0, True, None, 'export interface Grain'),
            ('packages/core/src/soil.ts', 'Kind', 'enum', 5, 5, 0, True, None, 'export enum Kind { Loam, Clay }'),
            ('packages/core/src/soil.ts', 'Soil', 'class', 4, 4, 0, True, None, 'export abstract class Soil {}'),
            ('packages/core/src/soil.ts', 'size', 'property', 2, 2, 1, True, None, 'size: number'),
            ('packages/web/src/page.tsx', 'Page', 'function', 3, 7, 0, True, None, 'export default function Page()'),
            ('srv/main.go', 'Max', 'constant', 20, 20, 0, True, None, 'const Max = 3'),
            ('srv/main.go', 'Server', 'struct', 9, 11, 0, True, 'Server serves.', 'type Server struct'),
            ('srv/main.go', 'Start', 'method', 13, 16, 0, True, None, 'func (s *Server) Start() error'),
            ('srv/main.go', 'helper', 'function', 18, 18, 0, False, None, 'func helper() {}'),
        ],
    ),
    'tree_imports': (
        {'path': 'VARCHAR', 'specifier': 'VARCHAR', 'line': 'BIGINT', 'names': 'VARCHAR'},
        [
            ('bin/run.sh', './env.sh', 1, ''),
            ('java/org/garden/App.java', 'java.util.List', 4, 'List'),
            ('java/org/garden/App.java', 'org.garden.util.Names', 3, 'Names'),
            ('jobs/run.py', '.store', 2, 'Shelf,of'),
            ('jobs/run.py', 'jobs.store', 1, 'st'),
            ('jobs/run.py', 'os', 1, 'os'),
            ('lib/src/lib.rs', 'bed', 1, 'bed'),
            ('lib/src/lib.rs', 'crate::bed::Row', 2, 'Row'),
            ('lib/src/lib.rs', 'crate::bed::deep::Thing', 2, 'T'),
            ('lib/src/lib.rs', 'std::io', 3, 'io'),
            ('packages/core/src/bed.ts', './soil', 1, 'Soil,Sand'),
            ('packages/core/src/bed.ts', 'node:fs', 2, 'fs'),
            ('packages/core/src/index.ts', './bed.js', 1, 'Bed,sow'),
            ('packages/core/src/index.ts', './soil', 2, ''),
            ('packages/web/src/page.tsx', '../../core/src/index', 1, 'Bed'),
            ('packages/web/src/page.tsx', 'react', 2, 'React'),
            ('packages/web/tests/page.test.tsx', '../src/page', 1, 'Page'),
            ('srv/main.go', 'fmt', 4, ''),
            ('srv/main.go', 'garden.test/log', 5, ''),
        ],
    ),
    'tree_files': (
        {'path': 'VARCHAR', 'language': 'VARCHAR', 'line_count': 'BIGINT', 'exports': 'VARCHAR'},
        [
            ('.gitignore', 'text', 1, ''),
            ('Makefile', 'shell', 4, ''),
            ('README.md', 'markdown', 13, 'Garden'),
            ('bin/run.sh', 'shell', 9, 'start,stop'),
            ('conf/app.toml', 'toml', 5, 'beds,rows'),
            ('conf/app.yaml', 'yaml', 5, 'name,beds,end'),
            ('db/schema.sql', 'sql', 8, 'beds,rows'),
            ('java/org/garden/App.java', 'java', 15, 'App'),
            ('java/org/garden/util/Names.java', 'java', 4, 'Names'),
            ('jobs/run.py', 'python', 26, 'Job,main,RETRIES'),
            ('jobs/store.py', 'python', 5, 'Shelf,shelf_of'),
            ('lib/src/bed.rs', 'rust', 5, 'Row,deep'),
            ('lib/src/lib.rs', 'rust', 15, 'Grow,Plot'),
            ('package.json', 'json', 1, ''),
            ('packages/core/package.json', 'json', 1, ''),
            ('packages/core/src/bed.ts', 'typescript', 36, 'Bed,plant,Row,limit'),
            ('packages/core/src/index.ts', 'typescript', 2, 'Bed,sow'),
            ('packages/core/src/soil.ts', 'typescript', 5, 'Grain,Soil,Kind'),
            ('packages/web/package.json', 'json', 1, ''),
            ('packages/web/src/page.tsx', 'typescript', 7, 'Page'),
            ('packages/web/tests/page.test.tsx', 'typescript', 2, ''),
            ('srv/main.go', 'go', 20, 'Server,Start,Max'),
        ],
    ),
    'tree_masked': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR', 'width': 'BIGINT'},
        [
            ('db/schema.sql', 2, 'CREATE TABLE IF NOT EXISTS beds (', 33),
            ('db/schema.sql', 3, 'id INT,', 30),
            ('db/schema.sql', 4, 'name TEXT', 11),
            ('db/schema.sql', 5, ');', 2),
            ('db/schema.sql', 7, 'create or replace view rows as', 30),
            ('db/schema.sql', 8, 'select 1;', 9),
            ('jobs/run.py', 1, 'import os, jobs.store as st', 27),
            ('jobs/run.py', 10, 'def start(self):', 20),
            ('jobs/run.py', 11, 'def inner():', 20),
            ('jobs/run.py', 12, 'return 1', 20),
            ('jobs/run.py', 14, 'return inner', 20),
            ('jobs/run.py', 16, '@property', 13),
            ('jobs/run.py', 17, 'def _secret(self):', 22),
            ('jobs/run.py', 18, 'return', 31),
            ('jobs/run.py', 2, 'from .store import Shelf, shelf_of as of', 40),
            ('jobs/run.py', 21, 'async def main(argv):', 21),
            ('jobs/run.py', 23, 'return Job()', 16),
            ('jobs/run.py', 26, 'RETRIES = 4', 11),
            ('jobs/run.py', 5, 'class Job(Shelf):', 17),
            ('jobs/run.py', 8, 'LIMIT = 3', 13),
            ('packages/core/src/bed.ts', 1, 'import { Soil, type Grain as Sand } from ;', 50),
            ('packages/core/src/bed.ts', 11, 'constructor(readonly name: string) {', 38),
            ('packages/core/src/bed.ts', 12, 'super();', 12),
            ('packages/core/src/bed.ts', 13, '}', 3),
            ('packages/core/src/bed.ts', 16, 'async put(', 12),
            ('packages/core/src/bed.ts', 17, 'plant: string,', 18),
            ('packages/core/src/bed.ts', 18, 'depth = 3,', 14),
            ('packages/core/src/bed.ts', 19, '): Promise<void> {', 20),
            ('packages/core/src/bed.ts', 2, 'import fs from ;', 25),
            ('packages/core/src/bed.ts', 20, 'const hidden = () => depth;', 31),
            ('packages/core/src/bed.ts', 21, 'if (plant === ) {', 24),
            ('packages/core/src/bed.ts', 22, 'this.rows += hidden();', 28),
            ('packages/core/src/bed.ts', 23, '}', 5),
            ('packages/core/src/bed.ts', 24, '}', 3),
            ('packages/core/src/bed.ts', 26, '#water() {}', 13),
            ('packages/core/src/bed.ts', 27, '}', 1),
            ('packages/core/src/bed.ts', 29, 'export const plant = async (name: string) => {', 46),
            ('packages/core/src/bed.ts', 31, 'return new Bed(name);', 23),
            ('packages/core/src/bed.ts', 32, '};', 2),
            ('packages/core/src/bed.ts', 33, 'const LIMIT = [1, 2];', 21),
            ('packages/core/src/bed.ts', 34, 'const pattern = g, text = plant( ) ;', 74),
            ('packages/core/src/bed.ts', 35, 'export type Row = { id: number };', 33),
            ('packages/core/src/bed.ts', 36, 'export { LIMIT as limit };', 26),
            ('packages/core/src/bed.ts', 8, 'export class Bed extends Soil {', 31),
            ('packages/core/src/bed.ts', 9, 'private rows = 0;', 19),
        ],
    ),
    'tree_edges': (
        {'src': 'VARCHAR', 'dst': 'VARCHAR'},
        [
            ('java/org/garden/App.java', 'java/org/garden/util/Names.java'),
            ('jobs/run.py', 'jobs/store.py'),
            ('lib/src/lib.rs', 'lib/src/bed.rs'),
            ('packages/core/src/bed.ts', 'packages/core/src/soil.ts'),
            ('packages/core/src/index.ts', 'packages/core/src/bed.ts'),
            ('packages/core/src/index.ts', 'packages/core/src/soil.ts'),
            ('packages/web/src/page.tsx', 'packages/core/src/index.ts'),
            ('packages/web/tests/page.test.tsx', 'packages/web/src/page.tsx'),
        ],
    ),
    'tree_externals': (
        {'src': 'VARCHAR', 'externals': 'VARCHAR'},
        [
            ('bin/run.sh', './env.sh'),
            ('java/org/garden/App.java', 'java.util.List'),
            ('jobs/run.py', 'os'),
            ('lib/src/lib.rs', 'std::io'),
            ('packages/core/src/bed.ts', 'node:fs'),
            ('packages/web/src/page.tsx', 'react'),
            ('srv/main.go', 'fmt,garden.test/log'),
        ],
    ),
    'tree_owners': (
        {'path': 'VARCHAR', 'owner': 'VARCHAR'},
        [
            ('.gitignore', 'garden'),
            ('Makefile', 'garden'),
            ('README.md', 'garden'),
            ('bin/run.sh', 'garden'),
            ('blob.bin', 'garden'),
            ('conf/app.toml', 'garden'),
            ('conf/app.yaml', 'garden'),
            ('db/schema.sql', 'garden'),
            ('java/org/garden/App.java', 'garden'),
            ('java/org/garden/util/Names.java', 'garden'),
            ('jobs/run.py', 'garden'),
            ('jobs/store.py', 'garden'),
            ('lib/src/bed.rs', 'garden'),
            ('lib/src/lib.rs', 'garden'),
            ('package.json', 'garden'),
            ('packages/core/package.json', '@garden/core'),
            ('packages/core/src/bed.ts', '@garden/core'),
            ('packages/core/src/index.ts', '@garden/core'),
            ('packages/core/src/soil.ts', '@garden/core'),
            ('packages/web/package.json', 'web'),
            ('packages/web/src/page.tsx', 'web'),
            ('packages/web/tests/page.test.tsx', 'web'),
            ('srv/main.go', 'garden'),
        ],
    ),
    'tree_diagnostics': (
        {'place': 'BIGINT', 'severity': 'VARCHAR', 'file': 'VARCHAR', 'line': 'BIGINT', 'col': 'BIGINT', 'code': 'VARCHAR', 'message': 'VARCHAR', 'source': 'VARCHAR'},
        [
            (1, 'error', 'src/a.ts', 3, 7, 'TS2322', 'Type mismatch.', 'tsc'),
            (10, 'error', 'packages/web/src/page.tsx', 4, 9, None, 'lonely', 'jest'),
            (11, 'error', 'srv/main.go', 14, 2, None, 'undefined: fmt', 'go'),
            (12, 'error', '/w/App.java', 5, 6, None, 'cannot find symbol', 'maven'),
            (13, 'error', None, None, None, 'TestBeds', 'test failed: TestBeds', 'go'),
            (14, 'error', None, None, None, None, 'out of memory', 'generic'),
            (15, 'warning', '/work/c.js', 1, 10, 'no-unused-vars', 'Unused thing', 'eslint'),
            (16, 'warning', 'foo.c', 1, 2, None, 'odd', 'generic'),
            (17, 'warning', None, None, None, None, 'unused import', 'cargo'),
            (18, 'info', 'foo.c', 1, 2, 'N1', 'here', 'generic'),
            (2, 'error', 'packages/web/src/page.tsx', 4, 9, 'TS2304', "Cannot find name 'Bed'.", 'tsc'),
            (3, 'error', '/work/c.js', 2, 1, None, 'Parsing error: no rule', 'eslint'),
            (4, 'error', 'lib/src/lib.rs', 13, 9, 'E0382', 'borrow of moved value', 'cargo'),
            (5, 'error', 'jobs/run.py', 21, None, 'ValueError', 'bad', 'python'),
            (6, 'error', 'tests/t.py', None, None, 'test_a', 'assert 1 == 2', 'pytest'),
            (7, 'error', 'tests/u.py', None, None, None, 'test failed', 'pytest'),
            (8, 'error', 'tests/v.py', 8, None, None, 'AssertionError: no', 'pytest'),
            (9, 'error', 'packages/web/tests/page.test.tsx', 2, 1, None, 'sum adds', 'jest'),
        ],
    ),
    'tree_diff': (
        {'path': 'VARCHAR', 'status': 'VARCHAR', 'previous': 'VARCHAR', 'ranges': 'VARCHAR', 'added': 'BIGINT', 'removed': 'BIGINT'},
        [
            ('jobs/store.py', 'deleted', None, '1-1', 0, 2),
            ('lib/src/bed.rs', 'renamed', 'lib/src/old.rs', '', 0, 0),
            ('packages/core/src/bed.ts', 'modified', None, '22-22,32-32', 2, 1),
            ('srv/main.go', 'added', None, '1-20', 1, 0),
        ],
    ),
    'tree_untracked': (
        {'path': 'VARCHAR', 'status': 'VARCHAR'},
        [
            ('conf/app.yaml', 'untracked'),
        ],
    ),
    'tree_default_base': (
        {'base': 'VARCHAR'},
        [
            ('master',),
        ],
    ),
    'tree_log_tail': (
        {'line_no': 'BIGINT', 'text': 'VARCHAR'},
        [
            (27, 'x FATAL: out of mem…'),
            (28, 'packages/web/src/pa…'),
            (29, 'nothing here 12:30:…'),
        ],
    ),
    'tree_map_folders': (
        {'folder': 'VARCHAR', 'path': 'VARCHAR', 'language': 'VARCHAR', 'line_count': 'BIGINT', 'n_in': 'BIGINT', 'n_out': 'BIGINT', 'score': 'DOUBLE', 'place': 'BIGINT'},
        [
            ('.', '.gitignore', 'text', 1, 0, 0, 0.0, 18),
            ('.', 'Makefile', 'shell', 4, 0, 0, 0.0, 19),
            ('.', 'README.md', 'markdown', 13, 0, 0, 0.207944, 17),
            ('.', 'package.json', 'json', 1, 0, 0, 0.0, 20),
            ('bin', 'bin/run.sh', 'shell', 9, 0, 0, 0.329584, 15),
            ('conf', 'conf/app.toml', 'toml', 5, 0, 0, 4.329584, 8),
            ('conf', 'conf/app.yaml', 'yaml', 5, 0, 0, 4.415888, 7),
            ('db', 'db/schema.sql', 'sql', 8, 0, 0, 0.329584, 16),
            ('java/org/garden', 'java/org/garden/App.java', 'java', 15, 0, 1, 4.554518, 6),
            ('java/org/garden/util', 'java/org/garden/util/Names.java', 'java', 4, 1, 0, 2.287386, 13),
            ('jobs', 'jobs/run.py', 'python', 26, 0, 1, 0.762462, 12),
            ('jobs', 'jobs/store.py', 'python', 5, 1, 0, 2.409025, 11),
            ('lib/src', 'lib/src/bed.rs', 'rust', 5, 1, 0, 2.409025, 5),
            ('lib/src', 'lib/src/lib.rs', 'rust', 15, 0, 1, 4.676157, 4),
            ('packages/core', 'packages/core/package.json', 'json', 1, 0, 0, 0.0, 21),
            ('packages/core/src', 'packages/core/src/bed.ts', 'typescript', 36, 1, 1, 2.908847, 3),
            ('packages/core/src', 'packages/core/src/index.ts', 'typescript', 2, 1, 2, 6.958331, 1),
            ('packages/core/src', 'packages/core/src/soil.ts', 'typescript', 5, 2, 0, 3.711725, 2),
            ('packages/web', 'packages/web/package.json', 'json', 1, 0, 0, 0.0, 22),
            ('packages/web/src', 'packages/web/src/page.tsx', 'typescript', 7, 1, 1, 2.633959, 10),
            ('packages/web/tests', 'packages/web/tests/page.test.tsx', 'typescript', 2, 0, 1, 0.346574, 14),
            ('srv', 'srv/main.go', 'go', 20, 0, 0, 4.415888, 9),
        ],
    ),
    'tree_map_focus': (
        {'path': 'VARCHAR', 'score': 'DOUBLE'},
        [
            ('packages/core/package.json', 0.0),
            ('packages/core/src/bed.ts', 22.908847),
            ('packages/core/src/index.ts', 26.241913),
            ('packages/core/src/soil.ts', 3.711725),
            ('packages/web/package.json', 0.0),
            ('packages/web/src/page.tsx', 2.633959),
            ('packages/web/tests/page.test.tsx', 0.346574),
        ],
    ),
    'tree_map_tree': (
        {'dir': 'VARCHAR', 'files': 'BIGINT', 'lines': 'BIGINT'},
        [
            ('', 4, 19),
            ('bin', 1, 9),
            ('conf', 2, 10),
            ('db', 1, 8),
            ('java', 0, 0),
            ('java/org', 0, 0),
            ('java/org/garden', 1, 15),
            ('java/org/garden/util', 1, 4),
            ('jobs', 2, 31),
            ('lib', 0, 0),
            ('lib/src', 2, 20),
            ('packages', 0, 0),
            ('packages/core', 1, 1),
            ('packages/core/src', 3, 43),
            ('packages/web', 1, 1),
            ('packages/web/src', 1, 7),
            ('packages/web/tests', 1, 2),
            ('srv', 1, 20),
        ],
    ),
    'tree_tally': (
        {'tally': 'VARCHAR'},
        [
            ('typescript×5 json×3 java×2 python×2 rust×2 shell×2',),
        ],
    ),
    'tree_outline': (
        {'name': 'VARCHAR', 'depth': 'BIGINT', 'handle': 'VARCHAR'},
        [
            ('Bed', 0, 'r006ad27a'),
            ('Row', 0, 'r061cfc80'),
            ('constructor', 1, 'r01f0ade4'),
            ('plant', 0, 'r33bf3025'),
            ('put', 1, 'r39cb824d'),
        ],
    ),
    'tree_outline_lines': (
        {'path': 'VARCHAR', 'detail': 'VARCHAR', 'n': 'BIGINT', 'line': 'VARCHAR'},
        [
            ('packages/core/src/bed.ts', 'full', 0, '  r006ad27a  export class Bed extends Soil  :8-27'),
            ('packages/core/src/bed.ts', 'full', 1, '    private rows = 0  :9'),
            ('packages/core/src/bed.ts', 'full', 2, '    r01f0ade4  constructor(readonly name: string)  :11-13'),
            ('packages/core/src/bed.ts', 'full', 3, '    r39cb824d  async put( plant: string, depth = 3, ): Promise<void>  :16-24'),
            ('packages/core/src/bed.ts', 'full', 4, '    rad26e665  #water() {}  :26'),
            ('packages/core/src/bed.ts', 'full', 5, '  r33bf3025  export const plant = async (name: string) =>  :29-32'),
            ('packages/core/src/bed.ts', 'full', 6, '  r94d760ee  const LIMIT = [1, 2]  :33'),
            ('packages/core/src/bed.ts', 'full', 7, '  re5062d6e  const pattern = /class [Nope] {/g, text = `function ${plant("x")} no() {`  :34'),
            ('packages/core/src/bed.ts', 'full', 8, '  r061cfc80  export type Row = { id: number }  :35'),
            ('packages/core/src/index.ts', 'full', 0, '  r0ea2a906  export { Bed, plant as sow } from "./bed.js"  :1'),
            ('packages/core/src/index.ts', 'full', 1, '  rd32ca08e  export * from "./soil"  :2'),
            ('packages/core/src/soil.ts', 'full', 0, '  rfd44c2fb  export interface Grain  :1-3'),
            ('packages/core/src/soil.ts', 'full', 1, '    size: number  :2'),
            ('packages/core/src/soil.ts', 'full', 2, '  r7de00685  export abstract class Soil {}  :4'),
        ],
    ),
    'tree_search': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR', 'symbol': 'VARCHAR', 'score': 'BIGINT', 'rank': 'DOUBLE'},
        [
            ('lib/src/lib.rs', 1, 'mod bed;', 'bed', 7, 1.7206),
            ('lib/src/lib.rs', 2, 'use crate::bed::{Row, deep::Thing as T};', None, 2, 1.7206),
            ('packages/core/src/bed.ts', 17, '    plant: string,', 'put', 3, 4.2277),
            ('packages/core/src/bed.ts', 29, 'export const plant = async (name: string) => {', 'plant', 7, 4.2277),
            ('packages/core/src/bed.ts', 34, 'const pattern = /class [Nope] {/g, text = `function ${plant("x")} no() {`;', 'pattern', 7, 4.2277),
            ('packages/core/src/bed.ts', 5, ' * A bed of plants.', None, 3, 4.2277),
            ('packages/core/src/bed.ts', 8, 'export class Bed extends Soil {', 'Bed', 7, 4.2277),
            ('packages/core/src/index.ts', 1, 'export { Bed, plant as sow } from "./bed.js";', './bed.js', 9, 5.0984),
            ('packages/web/src/page.tsx', 1, 'import { Bed } from "../../core/src/index";', None, 2, 2.5655),
            ('packages/web/src/page.tsx', 4, '  const bed = new Bed("herbs");', 'Page', 3, 2.5655),
        ],
    ),
    'tree_search_context': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR', 'hit': 'BOOLEAN'},
        [
            ('packages/web/src/page.tsx', 4, '  const bed = new Bed("herbs");', False),
            ('packages/web/src/page.tsx', 5, '  bed.put("basil");', True),
            ('packages/web/src/page.tsx', 6, '  return null;', False),
        ],
    ),
    'tree_search_counts': (
        {'hits': 'BIGINT', 'places': 'BIGINT', 'files': 'BIGINT'},
        [
            (10, 10, 4),
        ],
    ),
    'tree_search_symbols': (
        {'path': 'VARCHAR', 'name': 'VARCHAR', 'score': 'BIGINT'},
        [
            ('README.md', 'Beds', 65),
            ('conf/app.toml', 'beds', 68),
            ('conf/app.yaml', 'beds', 68),
            ('db/schema.sql', 'beds', 68),
            ('lib/src/lib.rs', 'bed', 103),
            ('packages/core/src/bed.ts', 'Bed', 108),
            ('packages/core/src/index.ts', './bed.js', 43),
        ],
    ),
    'tree_search_regex': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            ('packages/core/src/bed.ts', 31, '  return new Bed(name);'),
            ('packages/web/src/page.tsx', 4, '  const bed = new Bed("herbs");'),
        ],
    ),
    'tree_read_lines': (
        {'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            (4, ''),
            (5, 'class Job(Shelf):'),
            (6, '    """class Hidden: pass"""'),
        ],
    ),
    'tree_read_symbol': (
        {'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            (16, '  async put('),
            (17, '    plant: string,'),
            (18, '    depth = 3,'),
            (19, '  ): Promise<void> {'),
            (20, '    const hidden = () => depth;'),
            (21, '    if (plant === "}") {'),
            (22, '      this.rows += hidden();'),
            (23, '    }'),
            (24, '  }'),
        ],
    ),
    'tree_read_handle': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            ('jobs/store.py', 4, ''),
            ('jobs/store.py', 5, 'def shelf_of(x): return x'),
        ],
    ),
    'tree_skeleton': (
        {'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            (1, 'import { Soil, type Grain as Sand } from "./soil";'),
            (10, ''),
            (11, '  constructor(readonly name: string) {'),
            (12, '    super();'),
            (13, '  }'),
            (14, ''),
            (15, '  /** Puts a plant in. */'),
            (16, '  async put('),
            (17, '… 7 lines'),
            (2, 'import fs from "node:fs";'),
            (24, '  }'),
            (25, ''),
            (26, '  #water() {}'),
            (27, '}'),
            (28, ''),
            (29, 'export const plant = async (name: string) => {'),
            (3, ''),
            (30, '  // class Not {}'),
            (31, '  return new Bed(name);'),
            (32, '};'),
            (33, 'const LIMIT = [1, 2];'),
            (34, 'const pattern = /class [Nope] {/g, text = `function ${plant("x")} no() {`;'),
            (35, 'export type Row = { id: number };'),
            (36, 'export { LIMIT as limit };'),
            (4, '/**'),
            (5, ' * A bed of plants.'),
            (6, ' * @internal'),
            (7, ' */'),
            (8, 'export class Bed extends Soil {'),
            (9, '  private rows = 0;'),
        ],
    ),
    'tree_define': (
        {'path': 'VARCHAR', 'name': 'VARCHAR', 'start_line': 'BIGINT', 'via': 'VARCHAR'},
        [
            ('packages/core/src/bed.ts', 'Bed', 8, 'import'),
        ],
    ),
    'tree_define_local': (
        {'path': 'VARCHAR', 'name': 'VARCHAR', 'via': 'VARCHAR'},
        [
            ('srv/main.go', 'helper', 'local'),
        ],
    ),
    'tree_trace': (
        {'path': 'VARCHAR', 'hop': 'BIGINT', 'class': 'VARCHAR', 'owner': 'VARCHAR', 'crosses': 'BOOLEAN'},
        [
            ('packages/core/src/bed.ts', 1, None, '@garden/core', False),
            ('packages/core/src/index.ts', 1, 'entrypoint', '@garden/core', False),
            ('packages/web/src/page.tsx', 2, None, 'web', True),
            ('packages/web/tests/page.test.tsx', 3, 'test', 'web', True),
        ],
    ),
    'tree_trace_dependencies': (
        {'path': 'VARCHAR', 'hop': 'BIGINT', 'class': 'VARCHAR', 'owner': 'VARCHAR', 'crosses': 'BOOLEAN'},
        [
            ('lib/src/bed.rs', 1, None, 'garden', False),
        ],
    ),
    'tree_references': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR'},
        [
            ('packages/web/src/page.tsx', 4, '  const bed = new Bed("herbs");'),
        ],
    ),
    'tree_locate': (
        {'path': 'VARCHAR', 'symbol': 'VARCHAR', 'choices': 'BIGINT'},
        [
            ('jobs/run.py', None, 1),
            ('lib/src/lib.rs', 'grow', 1),
        ],
    ),
    'tree_changes': (
        {'path': 'VARCHAR', 'status': 'VARCHAR', 'previous': 'VARCHAR', 'added': 'BIGINT', 'removed': 'BIGINT', 'symbols': 'VARCHAR', 'dependents': 'BIGINT'},
        [
            ('conf/app.yaml', 'untracked', None, 0, 0, None, 0),
            ('jobs/store.py', 'deleted', None, 0, 2, 'Shelf', 1),
            ('lib/src/bed.rs', 'renamed', 'lib/src/old.rs', 0, 0, None, 1),
            ('packages/core/src/bed.ts', 'modified', None, 2, 1, 'plant,put', 1),
            ('srv/main.go', 'added', None, 1, 0, 'Max,Server,Start,helper', 0),
        ],
    ),
    'tree_still_imported': (
        {'path': 'VARCHAR', 'by': 'VARCHAR', 'more': 'BIGINT'},
        [
            ('jobs/store.py', 'jobs/run.py', 0),
        ],
    ),
    'tree_churn': (
        {'files': 'BIGINT', 'added': 'BIGINT', 'removed': 'BIGINT'},
        [
            (4, 3, 3),
        ],
    ),
    'tree_diagnose': (
        {'place': 'BIGINT', 'severity': 'VARCHAR', 'file': 'VARCHAR', 'line': 'BIGINT', 'col': 'BIGINT', 'code': 'VARCHAR', 'message': 'VARCHAR', 'source': 'VARCHAR', 'symbol': 'VARCHAR'},
        [
            (1, 'error', 'src/a.ts', 3, 7, 'TS2322', 'Type mismatch.', 'tsc', None),
            (10, 'error', 'packages/web/src/page.tsx', 4, 9, None, 'lonely', 'jest', 'Page'),
            (11, 'error', 'srv/main.go', 14, 2, None, 'undefined: fmt', 'go', 'Start'),
            (12, 'error', '/w/App.java', 5, 6, None, 'cannot find symbol', 'maven', None),
            (13, 'error', None, None, None, 'TestBeds', 'test failed: TestBeds', 'go', None),
            (14, 'error', None, None, None, None, 'out of memory', 'generic', None),
            (15, 'warning', '/work/c.js', 1, 10, 'no-unused-vars', 'Unused thing', 'eslint', None),
            (16, 'warning', 'foo.c', 1, 2, None, 'odd', 'generic', None),
            (17, 'warning', None, None, None, None, 'unused import', 'cargo', None),
            (18, 'info', 'foo.c', 1, 2, 'N1', 'here', 'generic', None),
            (2, 'error', 'packages/web/src/page.tsx', 4, 9, 'TS2304', "Cannot find name 'Bed'.", 'tsc', 'Page'),
            (3, 'error', '/work/c.js', 2, 1, None, 'Parsing error: no rule', 'eslint', None),
            (4, 'error', 'lib/src/lib.rs', 13, 9, 'E0382', 'borrow of moved value', 'cargo', 'grow'),
            (5, 'error', 'jobs/run.py', 21, None, 'ValueError', 'bad', 'python', 'main'),
            (6, 'error', 'tests/t.py', None, None, 'test_a', 'assert 1 == 2', 'pytest', None),
            (7, 'error', 'tests/u.py', None, None, None, 'test failed', 'pytest', None),
            (8, 'error', 'tests/v.py', 8, None, None, 'AssertionError: no', 'pytest', None),
            (9, 'error', 'packages/web/tests/page.test.tsx', 2, 1, None, 'sum adds', 'jest', None),
        ],
    ),
    'tree_problem_windows': (
        {'path': 'VARCHAR', 'line': 'BIGINT', 'text': 'VARCHAR', 'problem': 'BOOLEAN'},
        [
            ('jobs/run.py', 20, '', False),
            ('jobs/run.py', 21, 'async def main(argv):', True),
            ('jobs/run.py', 22, '    # def nothing(): pass', False),
            ('lib/src/lib.rs', 12, '    fn grow(&self) {', False),
            ('lib/src/lib.rs', 13, '        let s = "fn no() {";', True),
            ('lib/src/lib.rs', 14, '    }', False),
            ('packages/web/src/page.tsx', 3, 'export default function Page() {', False),
            ('packages/web/src/page.tsx', 4, '  const bed = new Bed("herbs");', True),
            ('packages/web/src/page.tsx', 5, '  bed.put("basil");', False),
            ('packages/web/tests/page.test.tsx', 1, 'import Page from "../src/page";', False),
            ('packages/web/tests/page.test.tsx', 2, 'Page();', True),
            ('srv/main.go', 13, 'func (s *Server) Start() error {', False),
            ('srv/main.go', 14, '\tfmt.Println("func Not() {")', True),
            ('srv/main.go', 15, '\treturn nil', False),
        ],
    ),
    'tree_problems_by_file': (
        {'file': 'VARCHAR', 'n': 'BIGINT', 'errors': 'BIGINT', 'first': 'BIGINT'},
        [
            ('/w/App.java', 1, 1, 12),
            ('/work/c.js', 2, 1, 3),
            ('jobs/run.py', 1, 1, 5),
            ('lib/src/lib.rs', 1, 1, 4),
            ('packages/web/src/page.tsx', 2, 2, 2),
            ('packages/web/tests/page.test.tsx', 1, 1, 9),
            ('src/a.ts', 1, 1, 1),
            ('srv/main.go', 1, 1, 11),
            ('tests/t.py', 1, 1, 6),
            ('tests/u.py', 1, 1, 7),
            ('tests/v.py', 1, 1, 8),
            (None, 2, 2, 13),
        ],
    ),
    'tree_notes': (
        {'id': 'VARCHAR', 'text': 'VARCHAR', 'score': 'BIGINT'},
        [
            ('n1', 'Beds need Water', 6),
            ('n3', 'water the beds', 6),
            ('n4', 'Water at noon', 6),
        ],
    ),
    'tree_notes_on': (
        {'id': 'VARCHAR', 'paths': 'VARCHAR'},
        [
            ('n2', 'jobs/run.py,jobs/store.py'),
        ],
    ),
    'tree_health': (
        {'level': 'VARCHAR', 'label': 'VARCHAR', 'n': 'BIGINT'},
        [
            ('ok', 'files without symbols', 6),
            ('ok', 'files', 23),
            ('ok', 'imports from outside', 8),
            ('warn', 'files not read', 1),
        ],
    ),
    'tree_checks': (
        {'name': 'VARCHAR', 'command': 'VARCHAR', 'origin': 'VARCHAR'},
        [
            ('lint:css', 'npm run --silent lint:css', 'package.json'),
            ('make:all', 'make all', 'Makefile'),
            ('make:seeds', 'make seeds', 'Makefile'),
            ('test', 'npm run --silent test', 'package.json'),
        ],
    ),
    'tree_path_kinds': (
        {'path': 'VARCHAR', 'kind': 'VARCHAR'},
        [
            ('', 'directory'),
            ('jobs', 'directory'),
            ('jobs/run.py', 'file'),
            ('nowhere', 'missing'),
        ],
    ),
    'tree_answer': (
        {'n': 'BIGINT', 'line': 'VARCHAR'},
        [
            (0, 'search — Bed'),
            (1, 'README.md:5  ## Beds'),
            (1099511627776, '[39/100 tok · 4 rows omitted]'),
            (1099511627777, 'next: read a file'),
            (2, 'db/schema.sql:1  -- Beds.'),
            (3, 'packages/core/src/bed.ts:8  export class Bed extends Soil {'),
        ],
    ),
    'tree_incremental': (
        {'src': 'VARCHAR', 'ref': 'VARCHAR', 'dst': 'VARCHAR', 'unlike_rebuild': 'BIGINT'},
        [
            ('java/org/garden/App.java', 'org.garden.util.Names', 'java/org/garden/util/Names.java', 0),
            ('jobs/run.py', '.late', 'jobs/late.py', 0),
            ('packages/core/src/bed.ts', './soil', 'packages/core/src/soil.ts', 0),
            ('packages/core/src/index.ts', './bed.js', 'packages/core/src/bed.ts', 0),
            ('packages/core/src/index.ts', './soil', 'packages/core/src/soil.ts', 0),
            ('packages/web/src/page.tsx', '../../core/src/index', 'packages/core/src/index.ts', 0),
            ('packages/web/tests/page.test.tsx', '../src/page', 'packages/web/src/page.tsx', 0),
        ],
    ),
}
