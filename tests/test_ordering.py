import random

from pyspark.sql import functions as F

from docflow.operators.ordering import dense_position, join_by_block, running_offset


def test_running_offset_with_small_buckets(spark):
    rng = random.Random(1)
    rows, expected = [], {}
    for key in ("hot", "b", "c"):
        total = 0
        positions = sorted(rng.sample(range(3000), 900 if key == "hot" else 20))
        for position in positions:
            value = rng.randint(0, 9)
            rows.append((key, position, value))
            expected[key, position] = total
            total += value
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, position bigint, value bigint")
    for bucket in (1, 7, 100000):
        got = running_offset(df, "position", "value", ["key"], bucket_rows=bucket).collect()
        assert {(r.key, r.position): r.offset for r in got} == expected


def test_running_offset_keeps_the_bucket(spark):
    df = spark.range(10).withColumn("value", F.lit(2).cast("bigint"))
    got = running_offset(df, "id", "value", bucket_rows=4, keep_bucket="part").orderBy("id").collect()
    assert [r.offset for r in got] == [2 * i for i in range(10)]
    assert [r.part for r in got] == [i // 4 for i in range(10)]


def test_dense_position_splits_a_hot_key(spark):
    rows = [(0 if i % 3 else i, i) for i in range(5000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "key bigint, id bigint")
    placed = dense_position(df, ["key", "id"], partitions=16)
    got = sorted((r.position, r.key, r.id) for r in placed.collect())
    assert [(k, i) for _, k, i in got] == sorted(rows)
    assert [p for p, _, _ in got] == list(range(5000))


def test_dense_position_of_nothing(spark):
    df = spark.createDataFrame([], "key bigint")
    assert dense_position(df, ["key"]).count() == 0


def test_join_by_block_equals_a_plain_join(spark):
    docs = spark.createDataFrame(
        [(0, 0, "a"), (1, 1, "b"), (2, 2500, "c"), (3, 5, "d")], "document_index bigint, page_count bigint, name string"
    )
    pages = docs.filter("page_count > 0 and document_index <> 3").selectExpr(
        "document_index", "explode(sequence(0L, page_count - 1)) as page_index"
    ).union(spark.createDataFrame([(9, 4)], "document_index bigint, page_index bigint"))
    for block in (3, 1024):
        joined = join_by_block(pages, docs, block=block)
        assert joined.count() == 2501
        assert joined.filter("name = 'c'").agg(F.max("page_index")).first()[0] == 2499
        assert join_by_block(pages, docs, "left_anti", block=block).collect() == [(9, 4)]
        assert join_by_block(pages, docs, "left_semi", block=block).count() == 2501


def test_intermediate_tables_are_removed(spark, tmp_path, monkeypatch):
    from docflow import session

    monkeypatch.setattr(session, "_made", [])
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    stored = session.materialize(spark.range(5).toDF("n"), "numbers")
    assert stored.count() == 5 and list(tmp_path.iterdir())
    assert session.remove_intermediate_tables(spark) == 1
    assert not list(tmp_path.iterdir()) and session.remove_intermediate_tables(spark) == 0
