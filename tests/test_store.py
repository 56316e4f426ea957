"""The log of numbered commits and the store that lies over a session folder."""

import json
import threading

import pytest

from loomframe.sources import commits, store


def test_commits_have_one_writer_each(spark, tmp_path):
    log, found = str(tmp_path / "log"), []
    work = lambda k: found.extend(commits.append(spark, log, {"k": k, "i": i}) for i in range(5))
    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == list(range(1, 16)) and len({(e["k"], e["i"]) for _, e in commits.read(spark, log)}) == 15
    with pytest.raises(FileExistsError):
        commits.append(spark, log, {}, number=15)
    assert commits.append(spark, log, {}, number=16) == 16 and commits.read(spark, str(tmp_path / "none")) == []
    path, files = commits._open(spark, log)  # stores other than local folders
    path = files.makeQualified(path)
    assert commits._rename(spark, path, 17, "{}") and not commits._rename(spark, path, 17, '{"late": 1}')
    assert commits.read(spark, log)[-1] == (17, {}) and not [p for p in (tmp_path / "log").iterdir() if len(p.name) > 30]


def test_newest_commit_holds(spark, tmp_path):
    at = str(tmp_path / "store")
    entry = lambda *rows: spark.createDataFrame([("s", *r) for r in rows], "session_id string, sample_id string, key string, value string")
    told = lambda: sorted((r.sample_id, r.key, r.value) for r in store.current(spark, at, "metadata").collect())
    assert told() == []
    store.save(at, metadata=entry(("a", "x", "1"), ("b", "x", "2")))
    store.save(at, metadata=entry(("a", "x", "3"), ("a", "y", '{"z":[1]}')))
    want = [("a", "x", "3"), ("a", "y", '{"z":[1]}'), ("b", "x", "2")]
    assert told() == want
    entry(("a", "x", "9")).write.parquet(f"{at}/metadata/not-committed")  # a flow that failed before its commit
    assert told() == want
    upto = store.live(spark, at, "metadata")[-1][0]
    assert store.compact(spark, at) == ["metadata"] and told() == want
    assert store.live(spark, at, "metadata")[0][0] == upto and store.compact(spark, at) == []
    store.save(at, metadata=entry(("b", "x", "4")))
    assert store.vacuum(spark, at) == 3 and told() == [*want[:2], ("b", "x", "4")]


def test_an_append_beside_a_compaction_is_kept(spark, tmp_path):
    at = str(tmp_path / "store")
    row = lambda status: spark.createDataFrame([("s", "a", status, None)], "session_id string, sample_id string, review_status string, corrections string")
    store.decide(spark, at, row("approved"))
    store.decide(spark, at, row("rejected"))
    store.current(spark, at, "review").drop("version").write.parquet(f"{at}/review/folded")
    assert store.decide(spark, at, row("approved")) == 3  # while the fold of the first two is being written
    commits.append(spark, f"{at}/_log", {"compact": {"review": {"path": "review/folded", "upto": 2}}})
    assert store.current(spark, at, "review").first().review_status == "approved"
    for bad in ("pending", None, "x"):
        with pytest.raises(ValueError):
            store.decide(spark, at, row(bad))


def test_merged_over_a_folder(spark, tmp_path):
    d = tmp_path / "s" / "samples" / "sample_000001"
    d.mkdir(parents=True)
    (d / "event.json").write_text(json.dumps({"timestamp_ms": 1.0, "action": "click"}))
    (d / "label.json").write_text(json.dumps({"confidence": 0.5}))
    (d / "metadata.json").write_text(json.dumps({"a": {"b": 1}, "filter": {"flags": ["old"]}}))
    (d / "review.json").write_text(json.dumps({"review_status": "edited", "review_corrections": {"x": 1}}))
    at = str(tmp_path / "store")
    bare = store.merged(spark, str(tmp_path)).first()
    assert store.merged(spark, str(tmp_path), at).first() == bare and bare.review_status == "edited"
    new = spark.createDataFrame([("s", "sample_000001", "filter", '{"flags":[]}')], "session_id string, sample_id string, key string, value string")
    only = spark.createDataFrame([("t", "sample_000001", (2.0, "hover"), "/p.png")], "session_id string, sample_id string, event struct<timestamp_ms:double,action:string>, image_path string")
    from loomframe.operators import labels

    only = only.withColumn("event", store.F.from_json(store.F.to_json("event"), labels.EVENT))
    store.save(at, metadata=new, event=only)
    store.decide(spark, at, spark.createDataFrame([("s", "sample_000001", "approved", None)], "session_id string, sample_id string, review_status string, corrections string"))
    rows = {r.session_id: r for r in store.merged(spark, str(tmp_path), at).collect()}
    assert json.loads(rows["s"].metadata) == {"a": {"b": 1}, "filter": {"flags": []}}
    assert (rows["s"].review_status, rows["s"].corrections, rows["s"].label.confidence) == ("approved", None, 0.5)
    assert (rows["t"].event.action, rows["t"].image_path, rows["t"].review_status, rows["t"].label) == ("hover", "/p.png", "pending", None)
