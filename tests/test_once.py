"""The chunk collection, the memo of results and the parsing of changed files: once, and safe to stop."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import resumable
from quarrylens.sinks.collection import CHUNK, Collection, WrongModel


def chunks(spark, rows):
    full = [(i, t, "s", d, "", "", 0, [1.0, 2.0]) for i, t, d in rows]
    return spark.createDataFrame(full, CHUNK)


def held(c):
    return {(r["domain"], r["chunk_id"]): r["text"] for r in c.read().collect()}


def test_seeding_twice_changes_nothing(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "m-1")
    assert c.version() == 0 and c.counts() == {} and held(c) == {}
    first = chunks(spark, [("1", "a", "net"), ("2", "b", "net"), ("1", "c", "app"), ("2", "b", "net")])
    assert c.upsert(first) == {"app": 1, "net": 2}
    before = held(c)
    assert c.upsert(first) == {"app": 1, "net": 2} and held(c) == before
    assert c.upsert(chunks(spark, [("2", "B", "net"), ("3", "d", "net")])) == {"app": 1, "net": 3}
    assert held(c) == {("net", "1"): "a", ("net", "2"): "B", ("net", "3"): "d", ("app", "1"): "c"}
    c.drop("net")
    assert held(c) == {("app", "1"): "c"} and c.counts() == {"app": 1}
    assert c.upsert(chunks(spark, [])) == {"app": 1}


def test_another_model_and_a_second_writer_fail(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "m-1")
    c.upsert(chunks(spark, [("1", "a", "net")]))
    with pytest.raises(WrongModel):
        Collection(spark, str(tmp_path), "m-2").read()
    with pytest.raises(WrongModel):
        Collection(spark, str(tmp_path), "m-2").upsert(chunks(spark, [("2", "b", "net")]))
    with pytest.raises(Exception, match="(?i)exists"):
        c._publish(0, c.manifest())  # a writer who began before the first version


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "m-1")
    c.upsert(chunks(spark, [("1", "a", "net")]))
    bad = chunks(spark, [("2", "b", "net")]).withColumn("text", F.when(F.col("chunk_id") == "2", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        c.upsert(bad)
    (tmp_path / "manifest" / "v2").mkdir()  # a manifest that was begun and not finished
    assert held(c) == {("net", "1"): "a"} and c.counts() == {"net": 1}


def test_results_are_kept_and_failures_tried_again(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    os.mkdir(log)

    def call(broken):
        def f(row):
            with open(f"{log}/{os.getpid()}", "a") as out:
                out.write(f"{row['t']}\n")
            if row["t"] in broken:
                raise ValueError("no answer")
            return row["t"].upper()

        return f

    work = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "i int, t string")
    calls = lambda: sorted(w for f in os.listdir(log) for w in open(f"{log}/{f}").read().split())
    got = {r["i"]: (r["value"], r["error"]) for r in resumable.resume(work, ["t"], call({"b"}), store, slices=3).collect()}
    assert got == {1: ("A", None), 2: (None, "ValueError: no answer"), 3: ("A", None), 4: ("C", None)} and calls() == ["a", "b", "c"]
    more = work.unionByName(spark.createDataFrame([(5, "d")], "i int, t string"))
    got = {r["i"]: r["value"] for r in resumable.resume(more, ["t"], call(set()), store).collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: "C", 5: "D"} and calls() == ["a", "b", "b", "c", "d"]


def test_a_run_that_is_stopped_ends_with_each_document_once(spark, tmp_path):
    store = str(tmp_path / "store")
    work = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "i int, t string")

    class Stop(BaseException):
        pass

    def dies(row):
        if row["t"] == "t7":
            os._exit(1)  # the worker is lost, and with it the slice
        return "first"

    with pytest.raises(Exception):  # noqa: B017
        resumable.resume(work, ["t"], dies, store, slices=4)
    before = resumable.results(spark, store).count()
    out = resumable.resume(work, ["t"], lambda row: "second", store, slices=4)
    values = [r["value"] for r in out.collect()]
    assert len(values) == 20 and values.count("first") == before < 20 and resumable.stored(spark, store).count() == 20


def test_only_changed_files_are_parsed(spark, tmp_path):
    files, store = tmp_path / "files", str(tmp_path / "store")
    files.mkdir()
    for n in "abc":
        (files / f"{n}.md").write_text(f"text {n}")
    parse = lambda df: df.select("path", F.length(F.col("content").cast("string")).cast("int").alias("n"), F.current_timestamp().alias("parsed_at"))
    name = lambda r: os.path.basename(r["path"])
    one, rates = resumable.parse_changed(spark, str(files), store, parse)
    first = {name(r): (r["n"], r["parsed_at"]) for r in one.collect()}
    assert rates.first()["new"] == 3 and rates.first()["hit_rate"] == 0
    two, rates = resumable.parse_changed(spark, str(files), store, parse)
    assert {name(r): (r["n"], r["parsed_at"]) for r in two.collect()} == first and rates.first()["hit_rate"] == 1
    os.utime(files / "a.md", (1, 1))
    (files / "b.md").write_text("longer text b")
    (files / "c.md").unlink()
    (files / "d.md").write_text("d")
    three, rates = resumable.parse_changed(spark, str(files), store, parse)
    got = {name(r): (r["n"], r["parsed_at"]) for r in three.collect()}
    r = rates.first()
    assert (r["same"], r["touched"], r["changed"], r["new"], r["gone"]) == (0, 1, 1, 1, 1)
    assert set(got) == {"a.md", "b.md", "d.md"} and got["a.md"] == first["a.md"] and got["b.md"][0] == 13
