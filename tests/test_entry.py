import __spark_entry__ as e


def test_entry_has_rows(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_importable_without_corpus(monkeypatch):
    import builtins

    real = builtins.__import__

    def no_corpus(name, *a, **k):
        if name in ("corpus_pipeline", "tidemark.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_corpus)
    assert not any(n.startswith("op") and n[2].isdigit() for n in e.queries())


def test_a_broken_import_is_not_taken_for_an_absent_subpackage(monkeypatch):
    import builtins

    import pytest

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("numpyy", name="numpyy")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
