import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.operators.daily import log_features
from behaviorlens.streaming import streams
from tests.test_baseline import START, reference


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_daily_counts_equal_batch(spark, tmp_path):
    rows = [(str(i), dt.datetime(2010, 1, 4) + dt.timedelta(hours=7 * i), f"u{i % 3}", f"PC-{i % 2}", "Logon" if i % 4 else "Logoff") for i in range(60)]
    log = spark.createDataFrame(rows, "id string, date timestamp_ntz, user string, pc string, activity string")
    log.write.parquet(str(tmp_path / "logon"))
    stream = streams.daily_counts(spark.readStream.schema(log.schema).parquet(str(tmp_path / "logon")), "logon")
    got = {(r.user, r.day): (r.logon_count, r.after_hours_logons, r.unique_pcs_used) for r in drain(stream, "counts", "complete").collect()}
    want = {(r.user, r.day): (r.logon_count, r.after_hours_logons, r.unique_pcs_used) for r in log_features(log, "logon").collect()}
    assert got == want


def test_deviations_equal_the_recursion(spark, tmp_path):
    xs = np.random.default_rng(0).poisson(3, 40)
    for k, part in enumerate((range(0, 10), range(10, 25), range(25, 40))):
        rows = [("u", START + dt.timedelta(i), [float(xs[i])]) for i in part]
        spark.createDataFrame(rows, "user string, day date, x array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "days"))
    source = spark.readStream.schema("user string, day date, x array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "days"))
    got = drain(streams.moving_deviations(source, ["x"], [0.1]), "deviations").orderBy("day").select(F.get("z", F.lit(0)).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx(reference(xs), abs=1e-9)
