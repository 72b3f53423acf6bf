import numpy as np
import pytest

from emberlog.llm.shared_files import SharedFiles


@pytest.mark.parametrize("mounted", [True, False])
def test_write_and_map(tmp_path, mounted):
    files = SharedFiles(f"file://{tmp_path}/model")
    if not mounted:
        # As for a store that cannot be mapped in place.
        files.local = None
    for values in (np.arange(5, dtype=np.uint64), np.zeros(0, np.int64), np.arange(7, dtype=np.uint64)):
        files.write("words-0", values)
        assert np.array_equal(files.read("words-0", values.dtype.str), values)
    assert [p.name for p in (tmp_path / "model").iterdir()] == ["words-0"]
