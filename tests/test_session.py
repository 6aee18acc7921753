"""Working tables and their end."""

from furrow import session


def test_working_tables_go_but_for_those_kept(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")

    def names():
        return sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if not p.name.startswith("."))

    session.stored(spark.range(3), "outside")
    with session.working_tables(spark) as outer:
        session.stored(spark.range(4), "outer")
        with session.working_tables(spark) as inner:
            session.stored(spark.range(5), "inner")
            kept = inner.keep(session.stored(spark.range(6), "kept"))
            assert names() == ["inner", "kept", "outer", "outside"]
        assert names() == ["kept", "outer", "outside"]
        outer.keep(kept)
    assert names() == ["kept", "outside"]
    assert kept.count() == 6
    try:
        with session.working_tables(spark):
            session.stored(spark.range(2), "failed")
            raise KeyError
    except KeyError:
        assert names() == ["kept", "outside"]
