"""Change-only upserts by bucket, folds, and pages that read the files they need."""

import os
import random

from tidemark.sources.keyed import Keyed, Pages
from tidemark.sources.paths import work_dir

SCHEMA = "kind string, id long, value string, flags array<string>"


def _files(path):
    return {os.path.join(top, n) for top, _, names in os.walk(path.removeprefix("file://")) for n in names if n.endswith(".parquet")}


def test_only_changed_rows_and_their_buckets_are_written(spark):
    rng, want, path = random.Random(4), {}, work_dir(spark, "keyed")
    own = Keyed(spark, path, SCHEMA, ("kind", "id"), buckets=8)

    def rows(df):
        return sorted(map(str, df.collect()))

    def upsert(batch, generation):
        want.update({r[:2]: r for r in batch})
        return own.upsert(spark.createDataFrame(batch, SCHEMA), generation)

    first = [(k, i, f"v{i}", None if i % 3 else ["a"]) for k in "xy" for i in range(60)]
    assert upsert(first, 1) == 120
    before = _files(path)
    assert upsert(first[:50], 2) == 0 and _files(path) == before  # nothing differs, no file
    assert upsert([("x", 7, None, None), *first[10:40]], 3) == 1
    new = _files(path) - before
    assert len([f for f in new if "/rows/" in f]) == 1  # one row, one bucket
    assert own.upsert(spark.createDataFrame([("x", 7, None, None)], SCHEMA), 3) == 1 and len(_files(path)) == len(before) + 2  # repeated
    for g in range(4, 9):
        upsert([(rng.choice("xyz"), rng.randrange(90), f"w{rng.randrange(5)}", []) for _ in range(1)] + [("z", 1000 + g, "n", None)], g)
    assert rows(own.rows()) == rows(spark.createDataFrame(list(want.values()), SCHEMA))
    assert rows(own.rows(2)) == rows(spark.createDataFrame(first, SCHEMA))  # an older reader
    folded = own.fold(20, most=2)
    assert folded and own.fold(21, most=2) == []
    assert rows(own.rows()) == rows(spark.createDataFrame(list(want.values()), SCHEMA))
    assert rows(own.rows(9)) == rows(own.rows())
    assert upsert([("x", 7, "back", None)], 22) == 1 and rows(own.rows()) == rows(spark.createDataFrame(list(want.values()), SCHEMA))
    kept = own.rows(buckets=[3])._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in kept.split("PartitionFilters: [")[1].split("]")[0]  # other buckets' files are not listed for reading


def test_a_page_reads_the_files_that_hold_it(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40), rng.choice("ab"), i, "p" * rng.randrange(5)) for i in range(1000)]
    path = work_dir(spark, "pages")
    own = Pages(spark, path, ("t", "kind", "id"))
    own.write(spark.createDataFrame(rows, "t long, kind string, id long, payload string"), 20)
    seen, after, most = [], None, 0
    while True:
        files = own.files(after, 31)
        most = max(most, len(files))
        page = own.page(after, 30)
        assert {os.path.basename(f) for f in page.inputFiles()} == {os.path.basename(f) for f in files}
        found = [tuple(r) for r in page.collect()]
        seen += found[:30]
        if len(found) <= 30:
            break
        after = found[29][:3]
    assert seen == sorted(rows) and most <= 3  # of 20 files with about 50 rows each
    assert own.page((99, "z", 0), 30).count() == 0
    empty = Pages(spark, work_dir(spark, "pages"), ("id",))
    empty.write(spark.createDataFrame([], "id long"), 3)
    assert empty.page(None, 5).count() == 0
