"""The tailing source: files that grow, are cut, replaced, renamed and restarted give every line once."""

from __future__ import annotations

import os
import time

import pytest

from recollect.sources.tail import TailReader, TailSource


@pytest.fixture
def tail(spark, tmp_path):
    """A function that runs all that is available into a table and gives the lines of this run."""
    spark.dataSource.register(TailSource)
    (tmp_path / "in").mkdir()
    told: list[tuple] = []

    def keep(df, epoch):
        told.extend((os.path.basename(r.path), r.byte, r.line) for r in df.collect())

    class Run:
        folder = tmp_path / "in"

        def start(self, **options):
            stream = spark.readStream.format("line_tail").options(suffix=".jsonl", **options).load(str(self.folder))
            return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="100 milliseconds").start()

        def lines(self, query):
            before = len(told)
            time.sleep(0.05)
            query.processAllAvailable()
            return sorted(told[before:])

    return Run()


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def test_each_line_once(spark, tail):
    a, b = tail.folder / "a.jsonl", tail.folder / "sub" / "b.jsonl"
    b.parent.mkdir()
    write(a, "one\ntwo\nthr")
    write(b, "x\n")
    write(tail.folder / "other.txt", "no\n")
    q = tail.start()
    assert tail.lines(q) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "x")]
    write(a, "ee\n\nfour\n")  # the open line is finished; an empty line is one
    assert tail.lines(q) == [("a.jsonl", 8, "three"), ("a.jsonl", 14, ""), ("a.jsonl", 15, "four")]
    assert tail.lines(q) == []
    write(b, "y\n", "w")  # cut and written anew, no longer than before
    assert tail.lines(q) == [("b.jsonl", 0, "y")]
    q.stop()
    write(a, "five\n")
    write(b, "z\n")
    q = tail.start()  # from its checkpoint
    assert tail.lines(q) == [("a.jsonl", 20, "five"), ("b.jsonl", 2, "z")]
    os.rename(a, tail.folder / "a.1.jsonl")  # rotated by name: the old file goes on, the new one begins
    write(tail.folder / "a.1.jsonl", "six\n")
    write(a, "new\n")
    assert tail.lines(q) == [("a.1.jsonl", 25, "six"), ("a.jsonl", 0, "new")]
    os.unlink(b)
    write(tail.folder / "c.jsonl", "é漢\r\nlast\n")
    assert tail.lines(q) == [("c.jsonl", 0, "é漢\r"), ("c.jsonl", 7, "last")]
    q.stop()


def test_parts_of_a_long_file_meet(tmp_path):
    lines = [f"{i} " + "x" * (i * 7 % 50) for i in range(500)] + ["y" * 5000, "end"]
    write(tmp_path / "l.jsonl", "\n".join(lines) + "\nopen")
    for size in (1, 13, 300, 10**6):
        reader = TailReader({"path": str(tmp_path), "partbytes": size})
        end = reader.latestOffset()
        parts = reader.partitions({}, end)
        got = [x for p in parts for batch in reader.read(p) for x in batch.column("line").to_pylist()]
        assert got == lines and (size > 1 or len(parts) == len("\n".join(lines)) + 1)


def test_idle_gate(tmp_path):
    write(tmp_path / "l.jsonl", "a\n")
    reader = TailReader({"path": f"file://{tmp_path}", "minidleseconds": 3600})
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    os.utime(tmp_path / "l.jsonl", (time.time() - 7200,) * 2)
    end = reader.latestOffset()
    assert [e["byte"] for e in end.values()] == [2]
    write(tmp_path / "l.jsonl", "b\n")
    assert reader.latestOffset() == end  # written to just now
    again = TailReader({"path": str(tmp_path), "minidleseconds": 3600})  # restarted: what the checkpoint holds must not be lost
    assert [e["byte"] for e in again.latestOffset().values()] == [4]
    assert TailReader({"path": str(tmp_path / "none")}).latestOffset() == {}
