import pyarrow as pa

from quire.llm import workspace


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"k": list(range(10))})
    assert [b.num_rows for b in workspace.slices([batch, batch.slice(0, 0)], 4)] == [4, 4, 2]


def test_unused_names_differ_in_any_case():
    assert workspace.unused(["a", "Row", "ROW_"], "row") == "row__" and workspace.unused([], "row") == "row"
