"""Row locks under intentions, and the classic anomalies."""

import threading
import time

import pytest

from larkspur.engine import Engine
from larkspur.errors import ExecError, TxnAbort


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("create table n(t varchar(30) primary key, a int32);")
    e.execute("insert into n values ('one', 1), ('two', 2), ('three', 3);")
    return e


def rows(e, sql="select t, a from n;", txn=None):
    return sorted(e.execute(sql, txn).rows())


def test_rows_are_locked_under_an_intention(engine):
    a, b = engine.begin(), engine.begin()
    engine.execute("update n set a = 10 where t = 'one';", a)
    assert engine.locks.mode(a.number, "n") == "IX" and engine.locks.mode(a.number, ("n", "one")) == "X"
    engine.execute("update n set a = 20 where 'two' = t and a > 0;", b)
    assert rows(engine, "select a from n where t = 'two';", b) == [(20,)]
    with pytest.raises(TxnAbort):
        engine.execute("select a from n where t = 'one';", engine.begin())  # younger than the writer
    engine.commit(b)
    assert rows(engine, txn=a) == [("one", 10), ("three", 3), ("two", 20)]
    assert engine.locks.mode(a.number, "n") == "SIX"
    engine.commit(a)
    assert rows(engine) == [("one", 10), ("three", 3), ("two", 20)]


def test_rows_of_both_stay_whoever_commits_first(engine):
    for first in (0, 1):
        txns = engine.begin(), engine.begin()
        engine.execute("delete from n where t = 'one';", txns[0])
        engine.execute("insert into n values ('four', 4), ('five', 5);", txns[1])
        engine.execute("insert into n values ('six', 6);", txns[0])
        engine.commit(txns[first])
        engine.commit(txns[1 - first])
        assert rows(engine) == [("five", 5), ("four", 4), ("six", 6), ("three", 3), ("two", 2)]
        engine.execute("delete from n where a > 3;")
        engine.execute("insert into n values ('one', 1);")


def test_keys_stay_unique_between_transactions(engine):
    a = engine.begin()
    engine.execute("insert into n values ('x', 1);", a)
    with pytest.raises(TxnAbort):
        engine.execute("insert into n values ('x', 2);")
    engine.commit(a)
    with pytest.raises(ExecError):
        engine.execute("insert into n values ('x', 2);")
    assert rows(engine, "select a from n where t = 'x';") == [(1,)]


def test_no_dirty_read_and_aborted_changes_vanish(engine):
    writer = engine.begin()
    engine.execute("update n set a = 99 where t = 'one';", writer)
    reader = engine.begin()
    with pytest.raises(TxnAbort):
        engine.execute("select * from n;", reader)
    engine.abort(writer)
    assert rows(engine, "select a from n where t = 'one';") == [(1,)]


def test_reads_repeat(engine):
    reader = engine.begin()
    assert rows(engine, "select a from n where t = 'one';", reader) == [(1,)]
    with pytest.raises(TxnAbort):
        engine.execute("update n set a = 5 where t = 'one';")
    engine.execute("update n set a = 5 where t = 'two';")
    assert rows(engine, "select a from n where t = 'one';", reader) == [(1,)]
    engine.commit(reader)


def test_no_phantoms(engine):
    reader = engine.begin()
    assert rows(engine, "select count(*) from n where a < 10;", reader) == [(3,)]
    with pytest.raises(TxnAbort):
        engine.execute("insert into n values ('new', 4);")
    assert rows(engine, "select count(*) from n where a < 10;", reader) == [(3,)]
    engine.commit(reader)


def test_no_lost_update_and_no_write_skew(engine):
    a, b = engine.begin(), engine.begin()
    for txn in (a, b):
        rows(engine, "select a from n where t = 'one';", txn)
    with pytest.raises(TxnAbort):  # the younger gives way
        engine.execute("update n set a = a + 1 where t = 'one';", b)
    engine.execute("update n set a = a + 1 where t = 'one';", a)
    engine.commit(a)
    c, d = engine.begin(), engine.begin()
    for txn in (c, d):
        rows(engine, "select sum(a) from n;", txn)
    with pytest.raises(TxnAbort):
        engine.execute("update n set a = 0 where t = 'two';", d)
    engine.execute("update n set a = 0 where t = 'one';", c)
    engine.commit(c)
    assert rows(engine) == [("one", 0), ("three", 3), ("two", 2)]


def test_an_older_transaction_waits_for_a_younger(engine):
    older, younger = engine.begin(), engine.begin()
    engine.execute("update n set a = 7 where t = 'one';", younger)
    done = []
    waiting = threading.Thread(target=lambda: done.append(rows(engine, "select a from n where t = 'one';", older)))
    waiting.start()
    waiting.join(1.0)
    assert waiting.is_alive()
    engine.commit(younger)
    waiting.join(60)
    assert done == [[(7,)]]
    engine.commit(older)


def test_transfers_keep_the_sum(engine):
    """Concurrent transfers between rows, tried again when they die."""
    engine.execute("update n set a = 100;")

    def transfer(source, target):
        for _ in range(600):
            txn = engine.begin()
            try:
                engine.execute(f"update n set a = a - 1 where t = '{source}';", txn)
                engine.execute(f"update n set a = a + 1 where t = '{target}';", txn)
                engine.commit(txn)
                return
            except TxnAbort:
                time.sleep(0.1)

    threads = [threading.Thread(target=transfer, args=x) for x in (("one", "two"), ("two", "three"), ("three", "one"), ("one", "three"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert rows(engine) == [("one", 99), ("three", 101), ("two", 100)]
    assert not engine.locks._held
