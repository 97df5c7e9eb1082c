"""The keyed store: commits are atomic, appends idempotent, overrides and deletes change what is read."""

import pytest

from staleguard.sources.store import Store, Taken


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id long, x string")


def content(store):
    return sorted(((r["id"], r["x"]) for r in store.read().collect()), key=repr)


def test_append_override_delete_and_compact(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ("id",))
    assert s.read() is None
    s.create(rows(spark, (1, "a"), (2, "b"), (None, "n")))
    assert s.append(rows(spark, (2, "B"), (3, "c"), (None, "m"))).count() == 1
    assert s.append(rows(spark, (2, "B"), (3, "c"))).count() == 0
    assert content(s) == sorted([(1, "a"), (2, "b"), (None, "n"), (3, "c")], key=repr)
    s.append(rows(spark, (2, "new"), (None, "null"), (9, "z")), "override")
    assert content(s) == sorted([(1, "a"), (2, "new"), (None, "null"), (3, "c"), (9, "z")], key=repr)
    s.delete(rows(spark, (2, ""), (3, "")))
    s.append(rows(spark, (3, "again")))
    want = sorted([(1, "a"), (None, "null"), (9, "z"), (3, "again")], key=repr)
    assert content(s) == want
    s.compact()
    assert content(s) == want and len(s.entries(s.versions()[-1])) == 1
    assert s.read(0).count() == 3


def test_a_killed_run_leaves_the_table_and_a_second_one_finishes_it(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "t"), ("id",))
    s.create(rows(spark, (1, "a")))

    def die(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            s.append(rows(spark, (2, "b")), "override")
    assert content(s) == [(1, "a")]
    for _ in range(2):
        s.append(rows(spark, (2, "b")), "override")
        assert content(s) == [(1, "a"), (2, "b")]


def test_of_two_writers_the_later_starts_again(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "t"), ("id",))
    s.create(rows(spark, (1, "a")))
    whole, met = Store._commit, []

    def race(self, version, entries):
        if not met:
            met.append(version)
            Store(spark, self.path, self.keys).append(rows(spark, (2, "first"), (3, "c")))
        return whole(self, version, entries)
    monkeypatch.setattr(Store, "_commit", race)
    assert [tuple(r) for r in s.append(rows(spark, (2, "second"), (4, "d"))).collect()] == [(4, "d")]
    assert content(s) == [(1, "a"), (2, "first"), (3, "c"), (4, "d")]
    with pytest.raises(Taken):
        whole(s, s.versions()[-1], [])


def test_wrong_calls(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ("id", "model"))
    for call in (s.create, s.append):
        with pytest.raises(ValueError, match="model"):
            call(rows(spark, (1, "a")))
    with pytest.raises(FileNotFoundError):
        s.compact()
    t = Store(spark, str(tmp_path / "u"), ("id",))
    t.create(rows(spark, (1, "a")))
    assert t.create(rows(spark, (5, "e")), "ignore") is None and content(t) == [(1, "a")]
    with pytest.raises(FileExistsError):
        t.create(rows(spark, (5, "e")))
    with pytest.raises(ValueError):
        t.append(rows(spark, (5, "e")), "replace")
