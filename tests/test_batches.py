"""What Python holds of a batch is bounded by bytes."""

import pyarrow as pa

from relsift.operators import batches, tree


def test_slices_by_bytes():
    rows = [("a" * n, None if n % 2 else "é" * n) for n in (0, 1, 5, 40, 3, 0, 100, 2, 2, 2)]
    batch = pa.RecordBatch.from_pylist([{"k": i, "x": x, "y": y} for i, (x, y) in enumerate(rows)], pa.schema([("k", pa.int64()), ("x", pa.string()), ("y", pa.string())]))
    got = list(batches.slices([batch.slice(0, 0), batch, batch.slice(7)], "x", "y", most=50))
    assert [k for s in got for k in s.column("k").to_pylist()] == [*range(10), 7, 8, 9]
    size = lambda s: sum(len((r["x"] or "") + (r["y"] or "")) + (r["y"] or "").count("é") for r in s.to_pylist())
    assert all(s.num_rows == 1 or 0 < size(s) <= 50 for s in got) and len(got) < 9


def test_diffs_leave_in_small_batches(spark, monkeypatch):
    """A batch of many large pairs is diffed and rebuilt a slice at a time."""
    texts = [(f"p{i}", "f.js", "x\n" * 1000 + f"{i}\n" * 100_000, f"{i}\n" * 100_000 + "y\n") for i in range(12)]
    seen = []
    frame = type(spark.range(0))
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: seen.append(f) or run(self, f, *a, **k))
    diffs = tree.unified_diffs(spark.createDataFrame(texts, "pair_id string, path string, from_text string, to_text string"), "from_text")
    tree.rebuilt(diffs)
    one = pa.RecordBatch.from_pylist([dict(zip(("pair_id", "path", "from_text", "to_text"), t)) for t in texts])
    made = list(seen[0](iter([one])))
    again = list(seen[1](iter(pa.RecordBatch.from_arrays([b.column(c) for c in ("pair_id", "path", "from_text", "unified_diff")], ["pair_id", "path", "from_text", "unified_diff"]) for b in made)))
    assert len(made) > 3 and len(again) >= len(made)
    assert [t for b in again for t in b.column("text").to_pylist()] == [t[3] for t in texts]
