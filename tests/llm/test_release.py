"""Memory that a task freed goes back at the task's and the group's end, and results pass unchanged."""
import pyarrow as pa

from concordia.llm import common


def test_release_at_the_ends(monkeypatch):
    done = []
    monkeypatch.setattr(common, "release", lambda: done.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])
    task = common.released(lambda batches: (b for b in batches))(iter([batch, batch]))
    assert next(task) is batch and not done
    assert list(task) == [batch] and len(done) == 1
    table = pa.table({"a": [1]})
    assert common.released_group(lambda t: t)(table) is table and len(done) == 2
