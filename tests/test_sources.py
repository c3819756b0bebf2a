import datetime as dt

import pytest

from behaviorlens import schema as S
from behaviorlens.operators.daily import daily_features, label_days, malicious_days
from behaviorlens.sources import csv_logs as L
from behaviorlens.sources.store import FeatureStore

FILES = {
    "logon.csv": "id,date,user,pc,activity\n{1},01/04/2010 06:30:00,AAF0535,PC-1,Logon\n{2},1/5/2010 6:10:00,AAF0535,PC-1,Logon\n{3},2010-01-05 20:00:00,AAF0535,PC-2,Logoff\n",
    "device.csv": "id,date,user,pc,activity\n{4},01/05/2010 10:00:00,AAF0535,PC-1,Connect\n",
    "http.csv": 'id,date,user,pc,url,content\n{5},01/05/2010 11:00:00,AAF0535,PC-1,http://linkedin.com/x,"a, b"\n',
    "email.csv": "id,date,user,pc,to,cc,bcc,from,size,attachments,content\n{6},01/05/2010 12:00:00,AAF0535,PC-1,a@dtaa.com;b@gmail.com,,,x@dtaa.com,2000000,1,hi\n",
    "file.csv": "id,date,user,pc,filename,content\n{7},01/05/2010 13:00:00,AAF0535,PC-1,a.doc,offer\n",
    "LDAP/2010-01.csv": "employee_name,user_id,email,role\nOld,AAF0535,old@dtaa.com,Temp\n",
    "LDAP/2010-02.csv": "Employee_Name,User_ID,Email,Role,Domain\nNew,AAF0535,x@dtaa.com,Engineer,dtaa\n",
    "psychometric.csv": "employee_name,user_id,O,C,E,A,N\nNew,AAF0535,1,2,3,4,5\n",
    "decoy_file.csv": 'decoy_filename,pc\n"""x.doc""","PC-1"\n',
    "answers/insiders.csv": "dataset,scenario,details,user,start,end\n4.2,1,d,AAF0535,01/05/2010 00:00:00,01/06/2010 12:00:00\n5.2,2,d,ZZZ,01/05/2010 00:00:00,01/06/2010 12:00:00\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_whole_folder(spark, folder, tmp_path):
    data = L.load(spark, str(folder))
    assert data.version == "r4x"
    features = label_days(daily_features(data.logs), malicious_days(data.insiders))
    rows = {r.day: r for r in features.collect()}
    r = rows[dt.date(2010, 1, 5)]
    assert (r.logon_count, r.logoff_count, r.after_hours_logons, r.unique_pcs_used, r.usb_connect_count) == (1, 1, 1, 2, 1)
    assert (r.email_sent_count, r.email_to_external_count, r.large_attachment_count, r.total_email_size) == (1, 1, 1, 2e6)
    assert (r.file_to_removable_count, r.job_search_visits, r.is_malicious) == (1, 1, 1)
    assert rows[dt.date(2010, 1, 4)].is_malicious == 0
    assert data.ldap.first().role == "Engineer" and "domain" not in data.ldap.columns
    assert data.decoy.first().decoy_filename == "x.doc" and data.psychometric.first().N == 5
    assert L.provenance(spark, str(folder)).count() == 7
    store = FeatureStore(spark, str(tmp_path / "store"))
    assert store.load("r4.2", "features") is None and store.is_stale("r4.2", str(folder))
    store.save("r4.2", "features", features)
    store.save_manifest("r4.2", rows=2)
    assert store.load("r4.2", "features").count() == 2 and store.manifest("r4.2")["rows"] == 2
    assert not store.is_stale("r4.2", str(folder))
    store.clear("r4.2")
    assert store.load("r4.2", "features") is None


def test_missing_files_are_empty_tables(spark, tmp_path):
    (tmp_path / "logon.csv").write_text(FILES["logon.csv"])
    data = L.load(spark, str(tmp_path), "r4.2")
    assert data.logs["http"].count() == 0 and data.insiders.count() == 0 and data.ldap.count() == 0
    row = daily_features(data.logs).first()
    assert row.http_request_count == 0 and row.total_email_size == 0.0


def test_release_drift(spark, tmp_path):
    (tmp_path / "http.csv").write_text("{1},01/04/2010 08:00:00,DTAA/ABC,PC-1,http://a.com\n")
    (tmp_path / "device.csv").write_text("id,date,user,pc,activity\n{2},1/4/2010 8:47:00,U,PC-1,Insert\n{3},1/4/2010 9:47:00,U,PC-1,Remove\n")
    assert L.detect(spark, str(tmp_path)) == "r1"
    assert L.load_log(spark, str(tmp_path), "http", L.adapter("r1")).first().user == "ABC"
    assert L.load_log(spark, str(tmp_path), "email", L.adapter("r1")).count() == 0
    got = L.load_log(spark, str(tmp_path), "device", L.adapter("r2")).orderBy("date").collect()
    assert [r.activity for r in got] == ["Connect", "Disconnect"] and got[0].date == dt.datetime(2010, 1, 4, 8, 47)
    with pytest.raises(ValueError):
        L.adapter("r9.9")
    with pytest.raises(FileNotFoundError):
        L.detect(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize(
    "http, email, family",
    [("id,date,user,pc,url", "id,date,to,from", "r2"), ("id,date,user,pc,url", "id,date,to,from,size,attachments,content", "r3x"), ("id,date,user,pc,url,content", "id,date,user,pc,to,activity", "r5x"), ("id,date,user,pc,url,activity,content", "id,date,user,pc,to,activity", "r6x")],
)
def test_detection(spark, tmp_path, http, email, family):
    (tmp_path / "http.csv").write_text(http + "\n")
    (tmp_path / "email.csv").write_text(email + "\n")
    assert L.detect(spark, str(tmp_path)) == family


def test_insiders(spark, folder):
    answers = str(folder / "answers")
    assert [r.user_id for r in L.load_insiders(spark, answers, "r5.2").collect()] == ["ZZZ"]
    assert L.load_insiders(spark, answers, "r4x").count() == 1
    with pytest.raises(ValueError):
        L.load_insiders(spark, answers, "r9.9")
    twice = L.load_insiders(spark, answers, "r4.2").union(L.load_insiders(spark, answers, "r4.2"))
    assert L.attack_windows(twice).count() == 1
    with pytest.raises(ValueError):
        S.require_columns(spark.createDataFrame([(1,)], "a int"), "logon")


def test_senders_are_resolved(spark):
    email = spark.createDataFrame([(None, "X@dtaa.com"), ("kept", "q@dtaa.com")], "user string, `from` string")
    ldap = spark.createDataFrame([("u1", "x@DTAA.com")], "user_id string, email string")
    assert sorted(r.user for r in L.resolve_senders(email, ldap).collect()) == ["kept", "u1"]


def test_splits_and_labels_of_a_folder(spark, folder):
    splits, labels = L.load_data(spark, str(folder), "2010-01-04 12:00:00", "2010-01-05 08:00:00")
    assert {s: x["logon"].count() for s, x in splits.items()} == {"train": 1, "val": 1, "test": 1} and set(splits["val"]) == set(L.LOGS)
    assert [(r.user, r.day) for r in labels.orderBy("day").collect()] == [("AAF0535", dt.date(2010, 1, 5)), ("AAF0535", dt.date(2010, 1, 6))]
    none, _ = L.load_data(spark, str(folder / "nowhere"), "2010-01-04", "2010-01-05")
    assert none["train"]["http"].count() == 0
