"""Writes that are broken off, tried again or meet; nothing shows but what is committed."""

import threading

import pytest
from pyspark.sql import functions as F

from cellframe.sources import commits
from cellframe.streaming import ingest

CELLS = "site string, product string, layer string, row int, col int, v double"


def layer(spark, name, value, n=6):
    return spark.createDataFrame([("s", "p", name, r, c, None if r == c else value + r) for r in range(n) for c in range(n)], CELLS)


def attrs(spark, **units):
    return spark.createDataFrame([(k, {"units": v}) for k, v in units.items()] or [("other", {"units": "x"})], "layer string, attrs map<string,string>")


def state(spark, root):
    cells = {r.layer: (r.n, r.v) for r in commits.read_cells(spark, root).groupBy("layer").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    rows = {r.layer: (r.cells, r.valid, r.median, r.attrs and r.attrs["units"], r.height, r.width) for r in commits.read_layers(spark, root).collect()}
    return cells, rows


def test_one_commit_for_all_three(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        commits.read_layers(spark, root)
    assert commits.write_layers(layer(spark, "a", 1.0).union(layer(spark, "b", 2.0)), attrs(spark, a="m"), root) == 1
    first = state(spark, root)
    assert first[1]["a"] == (36, 30, 3.5, "m", 6, 6) and first[1]["b"][3] is None

    def broken(*_):
        raise RuntimeError("lost")

    for part in ("layer_stats", "commit"):
        with monkeypatch.context() as m:
            m.setattr(commits, part, broken)
            with pytest.raises(RuntimeError):
                commits.write_layers(layer(spark, "a", 50.0), attrs(spark, a="ft"), root)
        assert state(spark, root) == first
    assert commits.write_layers(layer(spark, "a", 50.0, 4), attrs(spark, a="ft"), root) == 2
    second = state(spark, root)
    assert second[1]["a"] == (16, 12, 51.5, "ft", 4, 4) and second[1]["b"] == first[1]["b"] and second[0]["b"] == first[0]["b"]
    assert len(commits.sweep(spark, root)) == 3  # cells of both broken writes, layers of one
    assert state(spark, root) == second and commits.sweep(spark, root) == []


def test_numbers_are_given_once(spark, tmp_path):
    numbers = []
    work = [threading.Thread(target=lambda k=k: numbers.append(commits.commit(spark, str(tmp_path), f"f{k}", "x", 0))) for k in range(6)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    got = {(r.number, r.folder) for r in commits.commits(spark, str(tmp_path)).collect()}
    assert {n for n, _ in got} == set(range(1, 7)) and len({f for _, f in got}) == 6


def test_identity(spark):
    rows = [(r, c, float(r * c)) for r in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "row int, col int, v double")
    one = lambda x: commits.identity(x, []).first()
    same = one(df)
    assert (same.height, same.width, same.cells) == (4, 5, 20)
    assert one(df.repartition(3, "col").select("v", "col", "row")).digest == same.digest
    changed = [
        df.withColumn("v", F.col("v").cast("float")),
        df.withColumnRenamed("v", "w"),
        df.union(df.limit(1)),
        df.filter("not (row = 3 and col = 4)"),
        df.withColumn("v", F.when(F.col("v") == 12, None).otherwise(F.col("v"))),
        df.withColumn("v", F.when((F.col("row") == 0) & (F.col("col") == 0), -0.0).otherwise(F.col("v"))),
    ]
    assert len({one(x).digest for x in changed} | {same.digest}) == len(changed) + 1
    text = spark.createDataFrame([("", None), (None, "")], "a string, b string")
    swapped = spark.createDataFrame([("", ""), (None, None)], "a string, b string")
    assert commits.identity(text, [], None).first().digest != commits.identity(swapped, [], None).first().digest


def test_equal_tables_are_written_once(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    assert commits.write_table(df, root, "matches") == 1
    assert commits.write_table(df.orderBy(F.desc("id")), root, "matches") is None
    assert commits.write_table(df.limit(0), root, "matches") == 2
    assert commits.write_table(df.limit(0), root, "matches") is None
    assert commits.read_table(spark, root, "matches").count() == 0
    assert commits.write_table(df, root, "matches") == 3 and commits.read_table(spark, root, "matches").count() == 2
    with pytest.raises(FileNotFoundError):
        commits.read_table(spark, root, "findings")


def test_ingest_shows_only_what_its_ledger_names(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    cells = spark.createDataFrame([("s", "a", "k", r, 0, 1.0) for r in range(5)], "site string, layer string, content_key string, row int, col int, v double")
    cells.write.parquet(source)
    schema = "site string, layer string, content_key string, row int, col int, v double"
    ingest.ingest(spark, source, target, f"{tmp_path}/c1", schema).awaitTermination()
    cells.withColumn("row", F.col("row") + 100).write.partitionBy("site").parquet(f"{target}/cells/folder=lost-0")
    assert sorted(r.row for r in ingest.read_cells(spark, target).collect()) == list(range(5))
    ingest.ingest(spark, source, target, f"{tmp_path}/c2", schema).awaitTermination()
    assert sorted(r.row for r in ingest.read_cells(spark, target).collect()) == list(range(5))
