import glob
import json
import os

import pytest

from loamsift.sources import readers, writers


def test_csv_round_trip_keeps_text(spark, tmp_path):
    texts = ['quote " here', "line\nbreak", "crlf\r\nx", " lead and trail ", "back\\slash", 'a,"b",c',
             "é 中", '"']
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")
    writers.write_csv(df, f"{tmp_path}/c")
    back = readers.read_csv(spark, f"{tmp_path}/c", ("id", "body"))
    assert [r["body"] for r in back.orderBy("id").collect()] == texts


def test_csv_missing_values_and_header(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    with open(path, "w") as f:
        f.write(' Title ,BODY\nNA,x\n"null",N/A\nok,\n"nan",nan \n')
    rows = [tuple(r) for r in readers.read_csv(spark, path).collect()]
    assert rows == [(None, "x"), (None, None), ("ok", None), (None, "nan ")]
    assert readers.read_csv(spark, path).columns == ["title", "body"]


def test_row_ids_follow_the_file(spark, tmp_path):
    with open(tmp_path / "in.csv", "w") as f:
        f.write("title\n" + "".join(f"t{i}\n" for i in range(50)))
    df = readers.store_with_row_ids(readers.read_csv(spark, f"{tmp_path}/in.csv"), f"{tmp_path}/p")
    assert [r["title"] for r in df.orderBy("row_id").collect()] == [f"t{i}" for i in range(50)]


def test_missing_columns(spark):
    df = spark.createDataFrame([("t",)], "title string")
    assert readers.with_defaults(df, ("title", "body")).first()["body"] == ""
    with pytest.raises(ValueError, match="body"):
        readers.require_columns(df, ("title", "body"))


def test_issue_pages_skip_errors(spark, tmp_path):
    issue = {"id": 5, "title": "t", "body": None, "user": None, "state": "open", "comments": None}
    pages = {"a.json": [issue, issue | {"id": 6, "pull_request": {"url": "u"}}], "b.json": [],
             "c.json": {"message": "rate limit"}}
    for name, page in pages.items():
        with open(tmp_path / name, "w") as f:
            json.dump(page, f)
    with open(tmp_path / "d.json", "w") as f:
        f.write("<html>bad gateway</html>")
    df = readers.flatten_issue(readers.read_issue_pages(spark, str(tmp_path), multi_line=True))
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {5, 6} and rows[6]["is_pr"] and not rows[5]["is_pr"]
    assert rows[5]["login"] is None


def test_upload_dispatch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "Title string, extra int")
    writers.write_json(df, f"{tmp_path}/u.json")
    out = readers.read_upload(spark, f"{tmp_path}/u.json")
    assert set(out.columns) == {"title", "extra", "body"}
    with pytest.raises(ValueError):
        readers.read_upload(spark, f"{tmp_path}/u.xlsx")
    df.drop("Title").write.parquet(f"{tmp_path}/v.parquet")
    with pytest.raises(ValueError):
        readers.read_upload(spark, f"{tmp_path}/v.parquet")


def test_configs(spark, tmp_path):
    with open(tmp_path / "l.json", "w") as f:
        json.dump({"labels": {"bug": 0, "question": 1}, "id2label": {"0": "bug", "1": "question"}},
                  f, indent=2)
    rows = readers.label_names(readers.read_label_config(spark, f"{tmp_path}/l.json")).collect()
    assert sorted(map(tuple, rows)) == [(0, "bug", 0), (1, "question", 1)]
    with open(tmp_path / "m.json", "w") as f:
        json.dump({"test_acc": 0.8}, f)
    row = readers.read_metrics(spark, f"{tmp_path}/m.json").first()
    assert (row["test_acc"], row["test_f1"], row["test_report"], row["entry"]) == (0.8, 0.0, "", None)


def test_state_log_batch_and_report(spark, tmp_path):
    seen, done = readers.read_state(spark, f"{tmp_path}/s")
    assert seen.count() == 0 and done.count() == 0
    ids = spark.range(3)
    pairs = spark.createDataFrame([("bug", "r"), ("bug", "r")], "label string, repo string")
    writers.save_state(f"{tmp_path}/s", ids, pairs)
    writers.save_state(f"{tmp_path}/s", spark.range(3, 5), pairs)
    seen, done = readers.read_state(spark, f"{tmp_path}/s")
    assert seen.count() == 5 and done.distinct().count() == 1
    for bid in ("aaaa1111", "bbbb2222", "aaaa1111"):
        writers.write_batch(ids, f"{tmp_path}/b", bid)
    assert spark.read.parquet(f"{tmp_path}/b").count() == 6
    log = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05' ts, 'bug' label, 1.5D confidence, "
                    "'single' source, 'u' user")
    writers.append_log(log, f"{tmp_path}/l")
    writers.append_log(log, f"{tmp_path}/l")
    assert readers.read_log(spark, f"{tmp_path}/l").count() == 2
    assert len(glob.glob(f"{tmp_path}/l/log/*/day=2024-01-02")) == 2
    report = spark.createDataFrame([("1 stages", 2, "b", "7"), ("1 stages", 1, "a", "9")],
                                   "section string, line int, metric string, value string")
    writers.write_report(report, f"{tmp_path}/r")
    lines = [r["value"].split() for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert lines == [["1", "stages", "a", "9"], ["1", "stages", "b", "7"]]


def test_repo_catalog_and_pages(spark, tmp_path):
    page = {"items": [{"full_name": "a/b", "stargazers_count": 5, "open_issues_count": None,
                       "language": None, "topics": ["x"]}]}
    with open(tmp_path / "p.json", "w") as f:
        json.dump(page, f)
    repos = readers.read_repo_pages(spark, f"{tmp_path}/p.json")
    row = repos.first()
    assert (row["stars"], row["issues"], row["language"], row["fork"]) == (5, 0, "", None)
    writers.write_json(repos.select("full_name", "stars", "language", "issues"), f"{tmp_path}/c")
    assert readers.read_repo_catalog(spark, f"{tmp_path}/c").first()["full_name"] == "a/b"


def test_scratch_folder_is_the_shared_one(spark):
    from loamsift import session
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    shared = spark.conf.get(session.CHECKPOINT_CONF, None)
    if shared:
        assert session.scratch_root(spark) == shared.rstrip("/")


def test_scratch_is_cleared_by_application(spark, tmp_path, monkeypatch):
    from loamsift import session
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    kept = session.stash(spark.range(7), "t")
    assert kept.count() == 7 and len(os.listdir(f"{tmp_path}/loamsift")) == 1
    assert session.clear_scratch(spark) and os.listdir(f"{tmp_path}/loamsift") == []
