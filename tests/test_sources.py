"""Bodies of any size, and pages as a source that goes on where it was."""

import hashlib
import json
import os

from tidemark.operators import media
from tidemark.sources import pages
from tidemark.sources.paths import work_dir


def test_bodies_are_hashed_in_pieces(spark):
    root = work_dir(spark, "bodies")
    local = root.removeprefix("file://")
    os.makedirs(local)
    bodies = {"empty": b"", "small": b"abc", "long one": os.urandom(1 << 16) * 40, "bad": b"other"}
    for name, body in bodies.items():
        with open(f"{local}/{name}", "wb") as f:
            f.write(body)
    listed = spark.read.format("binaryFile").load(root).select("path")
    names = spark.createDataFrame([(n, f"{local}/{n}") for n in [*bodies, "absent"]], "name string, path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.hashed_files(names, chunk=1 << 12).collect()}  # far less than the long one
    assert {n: (r.size_bytes, r.sha256) for n, r in got.items() if n != "absent"} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    assert got["absent"].sha256 is None and got["absent"].error
    assert {r.path.rsplit("/", 1)[1]: r.sha256 for r in media.hashed_files(listed).collect()}.items() >= {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items() if b}.items()  # Spark lists no empty files
    declared = spark.createDataFrame([(n, len(b), hashlib.sha256(b if n != "bad" else b"x").hexdigest()) for n, b in bodies.items()] + [("absent", 0, "")], "name string, size_bytes long, sha256 string")
    ok = {r.name: (r.size_ok, r.hash_ok) for r in media.verified_files(names, declared).collect()}
    assert ok == {"empty": (True, True), "small": (True, True), "long one": (True, True), "bad": (True, False), "absent": (False, False)}


def test_a_page_is_hashed_with_bounded_memory(spark):
    """A sparse file of 3 GiB, more than a row can hold."""
    root = work_dir(spark, "bodies")
    local = root.removeprefix("file://")
    os.makedirs(local)
    with open(f"{local}/huge", "wb") as f:
        f.truncate(3 << 30)
    r = media.hashed_files(spark.createDataFrame([(f"{local}/huge",)], "path string")).first()
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range((3 << 30) >> 24):
        want.update(zeros)
    assert (r.size_bytes, r.sha256) == (3 << 30, want.hexdigest())


def test_page_source_resumes_behind_the_last_page(spark):
    pages.register(spark)
    root, out = work_dir(spark, "pages"), work_dir(spark, "out")
    local = root.removeprefix("file://")
    os.makedirs(local)

    def land(n):
        rows = [{"bucket_id": "b", "page": n, "id": 10 * n + i, "timestamp": f"t{i}", "duration": i, "data": {"n": [i, "ä"]} if i else None} for i in range(3)]
        with open(f"{local}/{n:04}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(map(json.dumps, rows)) + "\n\n")

    def run():
        stream = spark.readStream.format("activity_pages").load(root)
        query = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/data/batch={n}")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    land(1)
    land(2)
    assert run() == 6
    land(3)
    assert run() == 3 and run() == 0
    got = spark.read.parquet(f"{out}/data")
    assert sorted(r.id for r in got.collect()) == [10, 11, 12, 20, 21, 22, 30, 31, 32]
    assert {r.data for r in got.where("page = 3").collect()} == {None, '{"n":[1,"ä"]}', '{"n":[2,"ä"]}'}
    batch = spark.read.format("activity_pages").load(root)
    assert sorted(map(str, batch.collect())) == sorted(map(str, got.select(batch.columns).collect()))
