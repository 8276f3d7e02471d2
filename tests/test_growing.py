"""Growing text tables against what was appended, over restarts."""

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.sources import growing
from netlens.sources.growing import stream_growing

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("gone", T.DoubleType())])


class Poll:
    """A query that is started, drained and stopped again and again."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options, self.out = spark, folder, options, []

    def __call__(self):
        got = []
        flows = stream_growing(self.spark, f"{self.folder}/t.csv", SCHEMA, **self.options)

        def take(batch, _):
            got.extend(batch.orderBy("file_name", "file_place").collect())

        query = flows.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return [tuple(r)[:3] for r in got]


def append(folder, text):
    with open(f"{folder}/t.csv", "ab") as f:
        f.write(text.encode())


def test_append_cut_lines_replace_and_restart(spark, tmp_path):
    poll = Poll(spark, tmp_path)
    assert poll() == []  # not there yet
    append(tmp_path, "﻿x,a,n,other\n")
    assert poll() == []  # a header only
    append(tmp_path, "1.5,p,1,z\r\n2,q,oops,z\n3,r,3")
    assert poll() == [("p", 1, 1.5), ("q", None, 2.0)]  # the last line is not whole
    append(tmp_path, "0,z\n")
    assert poll() == [("r", 30, 3.0)]
    assert poll() == []
    append(tmp_path, ",s,,\n")
    append(tmp_path, "4,t,4,z\n\n")
    assert poll() == [("s", None, None), ("t", 4, 4.0)]
    (tmp_path / "t.csv").write_text("a,x,n\nshort,1,1\n")  # replaced by a shorter one
    assert poll() == [("short", 1, 1.0)]
    (tmp_path / "t.csv").write_text("a,x,n\n" + "other,2,2\n" * 40)  # replaced by a longer one
    assert poll() == [("other", 2, 2.0)] * 40
    (tmp_path / "t.csv").unlink()
    assert poll() == []
    append(tmp_path, "a,x,n\nagain,2,2\n")
    assert poll() == [("again", 2, 2.0)]


def test_tail_begins_at_the_end(spark, tmp_path):
    append(tmp_path, "a,x,n\nold,1,1\n")
    poll = Poll(spark, tmp_path, tail=True)
    assert poll() == []
    append(tmp_path, "new,1,1\n")
    assert poll() == [("new", 1, 1.0)]


def test_parts_of_a_large_file(spark, tmp_path):
    rows = [(f"r{k}" * (k % 7 + 1), k, k / 4) for k in range(3000)]
    append(tmp_path, "a,n,x\n" + "".join(f"{a},{n},{x}\n" for a, n, x in rows))
    assert Poll(spark, tmp_path, part_bytes=777)() == rows


def test_a_folder_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.csv").write_text(f"a,n\nx{k},{k}\n")
    (folder / "_tmp.csv").write_text("a,n\nno,9\n")

    def names():
        out = []
        rows = stream_growing(spark, str(folder), SCHEMA)
        q = rows.writeStream.foreachBatch(lambda b, _: out.extend(b.select("file_name", "a").collect()))
        q.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in out)

    assert names() == [("f0.csv", "x0"), ("f1.csv", "x1"), ("f2.csv", "x2")]
    with open(folder / "f1.csv", "a") as f:
        f.write("y,1\n")
    assert names() == [("f1.csv", "y")]


@pytest.mark.parametrize("text,want", [("", 0), ("abc", 0), ("a\n", 2), ("a\nbc", 2), ("\n" + "x" * 3_000_000, 1)])
def test_whole_lines(tmp_path, text, want):
    (tmp_path / "f").write_text(text)
    assert growing.whole_lines(arrow_fs.LocalFileSystem(), str(tmp_path / "f"), len(text)) == want


def test_alerts_of_a_growing_table(spark, tmp_path):
    from netlens.streaming.alerts import flow_schema

    append(tmp_path, "src_ip,flow_duration,unknown\n10.0.0.1,1.5,x\n")
    rows = stream_growing(spark, f"{tmp_path}/t.csv", flow_schema())
    assert rows.isStreaming and rows.columns[-2:] == ["file_name", "file_place"]
    out = []
    query = rows.writeStream.foreachBatch(lambda b, _: out.extend(b.select("src_ip", "flow_duration", F.col("dst_ip")).collect()))
    query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in out] == [("10.0.0.1", 1.5, None)]
