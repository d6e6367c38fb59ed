"""The page files of a corpus."""

from blogindex.plans import catalog
from tests.test_plans import DATA


def test_a_page_is_one_file(spark, tmp_path, monkeypatch):
    """No checksum file lies beside it, and no temporary one is left."""
    monkeypatch.setattr(catalog, "new_work_dir", lambda spark, name: str(tmp_path / name))
    rows = catalog.QUERIES["read_corpus"](spark, DATA).count()
    files = [p.name for p in tmp_path.rglob("*") if p.is_file() and "_SUCCESS" not in p.name]
    assert len(files) >= rows > 0 and all(f.endswith(".json") for f in files)
