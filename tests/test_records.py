"""The data source of records: offsets of a growing file, commits, restarts, broken lines."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinery.sources import records

SCHEMA = "id long, text string, tags array<string>, score double, _error string"


@pytest.fixture(autouse=True)
def registered(spark):
    records.register(spark)


def line(i, **more):
    return json.dumps({"id": i, "text": f"text {i} é", "tags": [str(i)], "score": i / 2} | more, ensure_ascii=False) + "\n"


def drain(df, path, name="copy", sink="records"):
    q = df.writeStream.format(sink).option("path", f"{path}/out").option("name", name).option("checkpointLocation", f"{path}/check-{name}").trigger(availableNow=True).start()
    q.awaitTermination()


def test_a_growing_file_is_read_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    f = src / "a.jsonl"
    f.write_text("".join(line(i) for i in range(50)) + '{"id": 50, "te', encoding="utf-8")  # the last line isn't whole
    stream = lambda: spark.readStream.format("records").schema(SCHEMA).load(str(src))
    ids = lambda: sorted(r.id for r in spark.read.format("records").schema("id long").load(f"{tmp_path}/out").collect())
    drain(stream(), tmp_path)
    assert ids() == list(range(50))
    with f.open("a", encoding="utf-8") as g:
        g.write('xt": "now whole"}\n' + "".join(line(i) for i in range(51, 80)))
    (src / "b.jsonl").write_text("".join(line(i) for i in range(80, 90)), encoding="utf-8")
    drain(stream(), tmp_path)  # a query started again goes on from its offset
    assert ids() == list(range(90))
    drain(stream(), tmp_path)
    assert ids() == list(range(90))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    spark.range(10).withColumn("text", F.lit("é")).write.format("records").mode("append").save(out)
    bad = spark.range(20).repartition(4).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("x").alias("text"))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("records").mode("append").save(out)
    read = spark.read.format("records").schema("id long, text string").load(out)
    assert sorted(r.id for r in read.collect()) == list(range(10))
    spark.range(5).withColumn("text", F.lit("y")).write.format("records").mode("overwrite").save(out)
    assert sorted((r.id, r.text) for r in spark.read.format("records").schema("id long, text string").load(out).collect()) == [(i, "y") for i in range(5)]


def test_a_batch_written_again_changes_nothing(tmp_path):
    from pyspark.sql.types import Row

    def batch(values):
        w = records.StreamWriter(str(tmp_path), "q")
        w.commit([w.write(iter([Row(id=v) for v in values])), None], 7)

    batch([1, 2])
    batch([1, 2])  # the driver died after the commit, before it noted it
    assert sum(n for _, n in records._list(str(tmp_path))) == len('{"id": 1}\n') * 2
    assert len(list((tmp_path / "data").iterdir())) == 1


def test_stretches_cover_every_line_once(tmp_path):
    f = tmp_path / "x.jsonl"
    text = "".join(line(i, text="z" * (i % 37)) for i in range(400))
    f.write_text(text, encoding="utf-8")
    size = len(text.encode())
    for split in (7, 64, 1000, size):
        got = b"".join(b for s in records.stretches(str(f), 0, size, split) for b in records._lines(str(tmp_path), s))
        assert got == text.encode()


def test_broken_lines_and_odd_values(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [line(1), "not json\n", "[1]\n", "\n", line(2, score="high"), line(3, more={"a": 1}), '{"text": {"a": "é"}}\n', line(4, id=None)]
    (tmp_path / "in" / "x.jsonl").write_text("".join(rows), encoding="utf-8")
    got = spark.read.format("records").schema(SCHEMA).load(f"{tmp_path}/in").collect()
    assert len(got) == 7 and sorted(r.id for r in got if r.id) == [1, 2, 3]
    assert sum(r._error is not None for r in got) == 3
    assert [r.text for r in got if r.text and r.text.startswith("{")] == ['{"a": "é"}']
    assert spark.read.format("records").schema("id long").load(f"{tmp_path}/nothing").count() == 0
    assert records.parsed(b"", pa.schema([("id", pa.int64())])).num_rows == 0
