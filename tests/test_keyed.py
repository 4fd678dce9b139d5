"""Tables with several writers."""

import pytest

from factline.sources import keyed
from factline.sources.keyed import Conflict, KeyedTable

SCHEMA = "name string, part int, value string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["name", "part"])


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_keys_are_added_once(spark, table):
    assert held(table) == []
    assert table.add(rows(spark, ("a", 1, "x"), ("a", 1, "x"), (None, 1, "n"))) == 1
    assert table.add(rows(spark, ("a", 1, "other"), (None, 1, "other"), ("a", None, "y"))) == 2
    assert held(table) == sorted([("a", 1, "x"), (None, 1, "n"), ("a", None, "y")], key=str)
    assert held(table, 1) == sorted([("a", 1, "x"), (None, 1, "n")], key=str)


def test_two_interleaved_writers(spark, table):
    table.add(rows(spark, ("old", 0, "0")))
    other = KeyedTable(spark, table.path, SCHEMA, table.keys)
    turns = iter([rows(spark, ("both", 1, "theirs"), ("theirs", 1, "t")), rows(spark, ("late", 1, "theirs"))])
    assert table.add(rows(spark, ("both", 1, "mine"), ("mine", 1, "m"), ("late", 1, "mine"), ("old", 0, "mine")), lambda: (r := next(turns, None)) and other.add(r)) == 4
    assert held(table) == sorted([("old", 0, "0"), ("both", 1, "theirs"), ("theirs", 1, "t"), ("late", 1, "theirs"), ("mine", 1, "m")], key=str)


def test_replacing_writers_lose_no_rows(spark, table):
    table.add(rows(spark, ("a", 1, "x"), ("b", 1, "x")))
    turns = iter([rows(spark, ("c", 1, "added"), ("d", 1, "added"))])
    table.replace(rows(spark, ("a", 1, "new"), ("c", 1, "new")), lambda: (r := next(turns, None)) and table.add(r))
    assert held(table) == [("a", 1, "new"), ("b", 1, "x"), ("c", 1, "new"), ("d", 1, "added")]
    again = iter([rows(spark, ("b", 1, "replaced"))])
    table.add(rows(spark, ("b", 1, "late"), ("e", 1, "e")), lambda: (r := next(again, None)) and table.replace(r))
    assert held(table) == [("a", 1, "new"), ("b", 1, "replaced"), ("c", 1, "new"), ("d", 1, "added"), ("e", 1, "e")]


def test_a_writer_that_died_leaves_nothing(spark, table, tmp_path, monkeypatch):
    table.add(rows(spark, ("a", 1, "x")))
    (tmp_path / "t" / "versions" / "000000002").write_text('["half')
    assert held(table) == [("a", 1, "x")] and table.add(rows(spark, ("b", 1, "y"))) == 3 and len(held(table)) == 2
    monkeypatch.setattr(keyed, "TRIES", 2)
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: False)
    with pytest.raises(Conflict):
        table.add(rows(spark, ("c", 1, "z")))
