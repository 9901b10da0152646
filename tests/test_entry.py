"""The driver's contract, with and without the corpus operators."""

import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert "interval_union" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names


def test_changed_regions_take_every_ninth_eighth_and_tenth_event(spark):
    """One event in nine is added, one in eight removed, one in ten renamed, and all errors have a new source."""
    events = {r["event_id"]: r["event_type"] for r in spark.read.parquet(f"{entry.SMALL}/events.parquet").where("round(value * 60) > 0").collect()}

    def why(i, kind):
        if i % 9 == 0 and i % 8 == 0:
            return None
        return "clip_added" if i % 9 == 0 else "clip_removed" if i % 8 == 0 else "clip_changed" if i % 10 == 0 else "clip_source_changed" if kind == "error" else None

    got = [r["reason"] for r in entry.queries()["changed_regions"](spark, entry.SMALL).collect()]
    assert sorted(got) == sorted(f"{why(i, kind)}:{i}" for i, kind in events.items() if why(i, kind))
