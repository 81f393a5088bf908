"""The maintained view of edges against resolving everything anew, and how little a batch touches."""

import random

import pytest

from loomlens.operators import edges, graph
from loomlens.sources.shared import fresh, written


def files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def table(spark, refs):
    return spark.createDataFrame([(s, r, c) for s, rs in refs.items() for r, c in (rs or {"": None}).items()], "src string, ref string, candidates array<string>")


def plain(there, refs):
    out = set()
    for s, rs in refs.items():
        for c in rs.values():
            dst = next((x for x in c or [] if x in there), None)
            out |= {(s, dst)} if dst not in (None, s) else set()
    return out


def degrees(pairs):
    nodes = {x for p in pairs for x in p}
    return {n: (sum(d == n for _, d in pairs), sum(s == n for s, _ in pairs)) for n in nodes}


def test_batches_equal_resolving_anew(spark):
    rng = random.Random(4)
    names = [f"f{i}" for i in range(30)]
    view, there, refs = edges.Edges(spark, fresh(spark, "edges")), set(), {}
    for batch in range(1, 7):
        added, gone = set(rng.sample(names, 5)), set(rng.sample(names, 4))
        there = (there - gone) | added  # what both came and went is there
        new = {rng.choice(names): {f"r{k}": rng.sample(names, rng.randrange(1, 4)) for k in range(rng.randrange(3))} for _ in range(4)}
        refs |= new
        report = view.apply(batch, files(spark, sorted(added) * 2), files(spark, sorted(gone)), table(spark, new))
        want = plain(there, refs)
        assert {tuple(r) for r in view.edges().collect()} == want
        assert {r.node: (r.n_in, r.n_out) for r in view.importance().collect()} == degrees(want)
        assert report["moved"] <= 9
    assert view.apply(6, files(spark, names)) is None and {tuple(r) for r in view.edges().collect()} == want


def test_a_batch_resolves_what_waits_for_it(spark):
    """10,000 references: one new file touches the two that wait for it, an unrelated one none."""
    view = edges.Edges(spark, fresh(spark, "edges"))
    refs = {f"s{i}": {"r": [f"new{i // 2}", f"old{i}"]} for i in range(10_000)}
    view.apply(1, files(spark, [f"old{i}" for i in range(10_000)]), refs=table(spark, refs))
    assert view.apply(2, files(spark, ["new7"])) == {"moved": 1, "sources": 2, "references": 2, "edges": 4}
    assert view.apply(3, files(spark, ["other", "new7"])) == {"moved": 1, "sources": 0, "references": 0, "edges": 0}
    assert view.apply(4, gone=files(spark, ["new7", "never"])) == {"moved": 1, "sources": 2, "references": 2, "edges": 4}
    assert view.edges().count() == 10_000


@pytest.mark.parametrize("few", [0, 1000])
def test_many_keys_are_joined_instead(spark, monkeypatch, few):
    monkeypatch.setattr(edges, "FEW", few)
    view = edges.Edges(spark, fresh(spark, "edges"))
    view.apply(1, files(spark, ["a", "b"]), refs=table(spark, {"x": {"r": ["b"], "q": ["c", "a"]}}))
    view.apply(2, files(spark, ["c"]), files(spark, ["b"]))
    assert {tuple(r) for r in view.edges().collect()} == {("x", "c")}
    view.apply(3, refs=table(spark, {"x": {}}))
    assert view.edges().collect() == [] and view.importance().collect() == []


def test_stored_rows_are_not_written_twice(spark, monkeypatch):
    """References and what waits for them go from the batch's own table to theirs; equal rows of the latter are one."""
    kept = []
    monkeypatch.setattr(edges, "written", lambda df, name: kept.append(name) or written(df, name))
    view = edges.Edges(spark, fresh(spark, "edges"))
    view.apply(1, files(spark, ["b"]), refs=table(spark, {"x": {"r": ["b", "b"], "q": ["b"]}}))
    assert not {"refs", "waits"} & set(kept)
    m = view.manifest()
    assert m["tables"]["waits"][0]["rows"] == view._table(m, "waits").count() == 1 and view.edges().collect() == [("x", "b")]


def test_resolve_agrees(spark):
    refs = table(spark, {"x": {"r": ["b", "a"]}, "y": {"r": ["z"]}})
    assert {(r.src, r.dst) for r in graph.resolve(refs, files(spark, ["a", "b"])).collect()} == {("x", "b"), ("y", None)}
