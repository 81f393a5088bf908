"""Archives are the same bytes however pages are dealt out, and licences are matched by whole names and versions."""

import hashlib
import random

import pytest

from loomlens.llm import licenses, warc


def test_shards_follow_from_the_pages_alone(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(-50, 400), f"http://h/{i}", rng.choice(["x" * rng.randrange(900), "same " * 300, "y" * 2000, None])) for i in range(300)] + [(None, "u", "z" * 3000), (None, None, "same " * 300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")
    told = []
    for k, parts in enumerate((1, 7, 23)):
        folder = str(tmp_path / f"a{k}")
        dealt = pages.repartition(parts) if k else pages.orderBy("html").coalesce(parts)
        manifest = warc.write_warc(dealt, folder, roll_bytes=3000, shard_bytes=10_000)
        files = {(f.file, f.records, f.sha1) for f in manifest.collect()}
        assert all(hashlib.sha1((tmp_path / f"a{k}" / f).read_bytes()).hexdigest() == sha for f, _, sha in files)
        assert warc.read_warc(manifest, folder).count() == len(rows)
        told.append(files)
    assert told[0] == told[1] == told[2]
    shards = {f.split("-")[1] for f, _, _ in told[0]}
    # As many as the sum of payloads asks for, about; and several files in a shard.
    assert 20 < len(shards) < 60 and len(told[0]) > len(shards)


@pytest.mark.parametrize("label, want", [("mit", 1.0), ("mitre", 0.1), ("mit-0", 1.0), ("bsl-1.0", 1.0), ("bsl-1.1", 0.1), ("busl-1.1", 0.2), ("bsd-3-clause", 1.0), ("bsd-2-clause-patent", 1.0), ("apache-2.0", 1.0), ("gpl-2.0-or-later", 0.4), ("gpl-3.0+", 0.4), ("gplx", 0.1), ("lgpl-2.1-only", 0.6), ("cc-by-nc-sa-4.0", 0.2), ("cc-by-4.0", 0.9), ("cc0-1.0", 1.0), ("agpl-3.0-only", 0.3), ("", 0.1), ("-", 0.1), ("reserved", 0.0)])
def test_freedom_by_whole_names(label, want):
    assert licenses.freedom(label) == want


def test_a_tag_without_its_colon_counts_for_nothing(spark):
    texts = ["SPDX-License-Identifier: MIT", "SPDX-License-Identifier MIT", "spdx license identifier", "SPDX-License-Identifier: Mitre OR MIT"]
    rows = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {0: ("mit", 1.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("mit,mitre", 1.0)}
