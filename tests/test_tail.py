"""Files that grow, are cut and are replaced while they are read."""

import random

import pytest

from larkspur.sources import tail


class Run:
    """A stream of a folder's lines into a table, one trigger at a time, each from a new query on the same checkpoint."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options = spark, root, options
        self.logs = root / "logs"
        self.logs.mkdir()

    def trigger(self):
        out = f"file://{self.root}/out"
        before = self.rows()
        q = tail.stream(self.spark, f"file://{self.logs}", "*.jsonl", **self.options).writeStream.format("parquet").option("checkpointLocation", f"file://{self.root}/checkpoint").trigger(availableNow=True).start(out)
        q.awaitTermination()
        new = self.rows()
        for r in before:
            new.remove(r)
        return sorted(r[2] for r in new)

    def rows(self):
        if not (self.root / "out").exists():
            return []
        return [(r.path.rsplit("/", 1)[1], r.at, r.value) for r in self.spark.read.schema(tail.SCHEMA).parquet(f"file://{self.root}/out").collect()]


def test_appended_cut_and_replaced_files_give_each_line_once(spark, tmp_path):
    run = Run(spark, tmp_path, rangeBytes=7)
    a, b = run.logs / "a.jsonl", run.logs / "b.jsonl"
    a.write_text("one\ntwo\nthr")
    (run.logs / "other.txt").write_text("no\n")
    assert run.trigger() == ["one", "two"]
    with a.open("a") as f:
        f.write("ee\nfour\n")
    b.write_text("é\n\nlong line of several ranges\n")
    assert run.trigger() == ["", "four", "long line of several ranges", "three", "é"]
    assert run.trigger() == []
    a.write_text("new\n")  # cut
    assert run.trigger() == ["new"]
    b.rename(run.logs / "b.old")
    b.write_text("another file that is longer than the one that was there before it\nx\n")  # rotated
    assert run.trigger() == ["another file that is longer than the one that was there before it", "x"]
    a.unlink()
    assert run.trigger() == []
    a.write_text("new\n")  # back again
    assert run.trigger() == ["new"]


def test_ranges_split_files_at_any_byte(tmp_path):
    rng = random.Random(3)
    text = "".join("".join(rng.choice("abé") for _ in range(rng.randrange(12))) + "\n" for _ in range(200)) + "no end"
    (tmp_path / "f").write_text(text)
    raw = text.encode()
    for size in (1, 3, 10, 1000, 1 << 20):
        for begin in (0, raw.index(b"\n", 300) + 1):
            ranges = tail._ranges(str(tmp_path / "f"), begin, len(raw), size=size)
            got = [(a.as_py(), v.as_py()) for r in ranges for b in tail._lines(r) for a, v in zip(b.column(1), b.column(2), strict=True)]
            assert [v for _, v in got] == raw[begin:].decode().split("\n")
            assert all(raw[a:].startswith(v.encode()) for a, v in got)


@pytest.mark.parametrize("range_bytes", [5, 1 << 20])
def test_the_end_of_a_file(spark, tmp_path, range_bytes):
    f = tmp_path / "x.log"
    f.write_text("alpha\nbeta\ngamma\n\ndelta\n")

    def got(*a, **b):
        rows, state = tail.tail(spark, str(f), *a, rangeBytes=range_bytes, **b)
        return [r.value for r in rows.collect()][::-1], state

    assert got() == (["alpha", "beta", "gamma", "", "delta"], {"cursor": 24, "size": 24, "reset": False, "truncated": False})
    assert got(limit=2)[0] == ["", "delta"]
    assert got(most=9) == (["", "delta"], {"cursor": 24, "size": 24, "reset": False, "truncated": True})
    assert got(most=7)[0] == ["", "delta"]  # from the start of a line
    assert got(6)[0] == ["beta", "gamma", "", "delta"]
    assert got(8)[0] == ["gamma", "", "delta"]
    assert got(24) == ([], {"cursor": 24, "size": 24, "reset": False, "truncated": False})
    assert got(99, most=8) == (["", "delta"], {"cursor": 24, "size": 24, "reset": True, "truncated": True})
    assert got(2, most=6) == (["delta"], {"cursor": 24, "size": 24, "reset": True, "truncated": True})
    assert tail.tail(spark, str(tmp_path / "none"))[0].collect() == []
