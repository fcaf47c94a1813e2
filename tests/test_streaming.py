"""Pairs from a stream of releases, over several micro-batches."""

import json

from relsift.streaming.watch import pairs


def test_pairs(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batches = [[("a", "1", "2024-01-01"), ("b", "1", "2024-01-02"), ("a", "2", "2024-01-03")], [("a", "3", "2024-01-05")], [("a", "2.5", "2024-01-04"), ("b", "2", "2024-01-06")]]
    got = []
    stream = spark.readStream.schema("package string, version string, published_at timestamp").json(str(source))

    def run():
        spark.sparkContext.environment["PYTHONPATH"] = __file__.rsplit("/tests/", 1)[0]
        query = pairs(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: got.extend((r.package, r.from_version, r.to_version) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)

    for k, rows in enumerate(batches):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("package", "version", "published_at"), r))) for r in rows))
        run()
    assert sorted(got, key=repr) == sorted([("a", None, "1"), ("a", "1", "2"), ("a", "2", "3"), ("b", None, "1"), ("b", "1", "2")], key=repr)
