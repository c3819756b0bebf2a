import datetime as dt
import hashlib

import pytest
from pyspark.errors import StreamingQueryException

from behaviorlens.operators.daily import daily_features
from behaviorlens.sources import csv_logs as L
from behaviorlens.sources.store import FeatureStore
from behaviorlens.streaming.ingest import LogSink, ingest, read_csv_stream

COLUMNS = ["id", "date", "user", "pc", "activity"]


def write_chunks(folder, chunks=6, rows=20):
    folder.mkdir()
    for c in range(chunks):
        lines = ["id,date,user,pc,activity"]
        for i in range(c * rows, (c + 1) * rows):
            when = dt.datetime(2010, 1, 4) + dt.timedelta(hours=5 * (i * 7 % 40))  # chunks share days
            lines.append(f'{{{i}}},{when:%m/%d/%Y %H:%M:%S},u{i % 3},"PC-{i % 4}",{("Logon", "Logoff")[i % 2]}')
        lines.append(f"{{x{c}}},not a date,u1,PC-1,Logon")
        (folder / f"part-{c}.csv").write_text("\n".join(lines) + "\n")


def as_set(df):
    return sorted(map(str, [r.asDict() for r in df.select(sorted(df.columns)).collect()]))


class Breaks(LogSink):
    """Stops once between the events of a chunk and its features, and once before anything of another."""

    failed: set = set()

    def __call__(self, rows, chunk):
        if chunk == 4 and chunk not in self.failed:
            self.failed.add(chunk)
            raise RuntimeError("stopped")
        super().__call__(rows, chunk)

    def logs(self, spark, like):
        if not self.failed:
            self.failed.add(2)
            raise RuntimeError("stopped")
        return super().logs(spark, like)


def test_a_stopped_run_goes_on_and_every_row_is_there_once(spark, tmp_path):
    write_chunks(tmp_path / "logon")
    family = L.adapter("r4.2")
    batch = L.canonical(L.read_csv(spark, f"{tmp_path}/logon/*.csv", COLUMNS).where("id <> 'id'"), "logon", family)
    want = as_set(daily_features({"logon": batch.where("date is not null")}))
    sink = Breaks(FeatureStore(spark, str(tmp_path / "store")), "r4.2", lambda rows: {"logon": rows})
    stream = lambda: read_csv_stream(spark, str(tmp_path / "logon"), COLUMNS, "logon", family, max_files=1)
    for _ in range(2):
        with pytest.raises(StreamingQueryException, match="stopped"):
            ingest(stream(), sink, str(tmp_path / "checkpoint"))
    ingest(stream(), sink, str(tmp_path / "checkpoint"))
    assert as_set(sink.features(spark)) == want
    stored = spark.read.parquet(str(tmp_path / "store" / "r4.2" / "events" / "logon"))
    assert stored.count() == 120 and stored.select("id").distinct().count() == 120 and stored.select("chunk").distinct().count() == 6
    # Nothing new: nothing happens. One more file: one more chunk.
    ingest(stream(), sink, str(tmp_path / "checkpoint"))
    assert as_set(sink.features(spark)) == want
    (tmp_path / "logon" / "more.csv").write_text("id,date,user,pc,activity\n{900},01/04/2010 06:00:00,new,PC-1,Logon\n")
    ingest(stream(), sink, str(tmp_path / "checkpoint"))
    assert {r.user for r in sink.features(spark).collect()} == {"u0", "u1", "u2", "new"}


def test_a_header_that_differs_is_an_error(spark, tmp_path):
    (tmp_path / "logon").mkdir()
    (tmp_path / "logon" / "a.csv").write_text("id,date,pc,user,activity\n{1},01/04/2010 06:00:00,PC-1,u,Logon\n")
    sink = LogSink(FeatureStore(spark, str(tmp_path / "store")), "r4.2", lambda rows: {"logon": rows})
    with pytest.raises(StreamingQueryException):
        ingest(read_csv_stream(spark, str(tmp_path / "logon"), COLUMNS, "logon", L.adapter("r4.2")), sink, str(tmp_path / "checkpoint"))
    assert sink.features(spark) is None


def test_provenance_reads_the_first_bytes_alone(spark, tmp_path):
    small, large = b"id,date\n", b"x" * 70_000
    (tmp_path / "a.csv").write_bytes(small)
    with open(tmp_path / "b.csv", "wb") as f:
        f.write(large)
        f.truncate(3 << 30)  # a file over 2 GB, of holes
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.csv").mkdir()
    found = L.provenance(spark, str(tmp_path)).collect()
    assert [(r.path.rpartition("/")[2], r.length, r.sha256) for r in found] == [("a.csv", 8, hashlib.sha256(small).hexdigest()), ("b.csv", 3 << 30, hashlib.sha256(large[:65536]).hexdigest())]
    assert L.provenance(spark, str(tmp_path / "nowhere")).count() == 0
