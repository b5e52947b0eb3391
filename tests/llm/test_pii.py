import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from larkspur.llm import pii
from larkspur.llm.common import Scratch, read_table

RE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in RE[kind].finditer(text or "") if ok(kind, m.group())]
    return sorted(found)


def texts():
    rng = random.Random(12)
    parts = ["a@b.c", "x.y%z+1@ho-st.co.uk", "@", "a@b", "b.c", ".", "1.2.3.4", "256.1.1.1", "10.0.0.255", "001.2.3.04", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+49.30.1234567", "+", "(", "-", " ", "12", "7", "😀", "é", "\n", "4", "5", "0", "%d@e.f"]
    yield from ["", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "a@b@c.d", "+1 2", "4111 1111 1111 1111 ", "999.1.1.1.1", "😀 a@b.co 😀 1.2.3.4"]
    for _ in range(400):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))


def test_base_spans_equal_definition(spark):
    data = [(i, t) for i, t in enumerate(texts())] + [(9999, None)]
    got = pii.base_spans(spark.createDataFrame(data, "doc_id long, text string")).collect()
    for r in got:
        assert [(x.s, x.k, x.e) for x in r.base or []] == brute(r.text), r.text


def test_long_texts(spark):
    data = [(1, "a" * 300_000), (2, "a." * 200_000 + "@"), (3, "1" * 300_000), (4, "1 " * 200_000), (5, "1." * 200_000), (6, "+1" + " " * 300_000), (7, "a@b" + ".c" * 200_000), (8, "x@y.zz 1.2.3.4 " * 20_000), (9, "+1 " * 50_000)]
    t = time.time()
    got = {r.doc_id: r.n for r in pii.base_spans(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", F.size("base").alias("n")).collect()}
    assert got[8] == 40_000 and got[7] == 1 and got[5] == 50_000 and time.time() - t < 90


def test_query_rows(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = pii.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    for r in got:
        spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in truth[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in truth[r.doc_id]) for i in range(4)]
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_contexts_discover_unseen(spark):
    rng = random.Random(3)
    data = []
    for i in range(60):
        data.append((i, f"please call hotline: +1 ({rng.randint(200, 999)}) 555-{i:04d} now", "x"))
        data.append((100 + i, f"write to mailbox: user{i}@host{i}.org today, room {i} of the house", "x"))
    data += [(500, "you can write to mailbox: jane(at)host.org if you like room 12", None), (501, "the mailbox: is closed, room 77 too", None), (None, None, None), (502, "", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, base string")
    found = pii.find_pii(df, Scratch(spark, "t"))
    got = {r.doc_id: r for r in found.collect()}
    assert [got[500].text[x.s : x.e] for x in got[500].spans] == ["jane(at)host.org"] and not got[500].base
    assert not got[501].spans and not got[None].spans and not got[502].spans
    for r in got.values():
        assert {tuple(x) for x in r.base or []} <= {tuple(x) for x in r.spans or []}
    assert pii.find_pii(df.limit(0), Scratch(spark, "t")).count() == 0
    assert "Python" not in found._jdf.queryExecution().toString()


def test_instances_with_at_sign_words(spark):
    """An obfuscated address has no digit or @; one with a digit is discovered behind a trusted context."""
    data = [(i, f"write to mailbox: user{i}@host{i}.org today") for i in range(40)] + [(900, "or write to mailbox: user7(at)host.org today")]
    found = pii.find_pii(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t")).where("doc_id = 900").collect()[0]
    assert [found.text[x.s : x.e] for x in found.spans] == ["user7(at)host.org"] and found.base == []


def test_masking(spark):
    data = [(i, t) for i, t in enumerate(texts())]
    df = pii.base_spans(spark.createDataFrame(data, "doc_id long, text string")).withColumn("spans", F.col("base"))
    for r in pii.mask_pii(df).collect():
        text, out, upto = data[r.doc_id][1], "", 0
        for s, k, e in brute(text):
            out += text[upto:s] if s > upto else ""
            out += pii.MASK[pii.KINDS[k]] if s >= upto else ""
            upto = max(upto, e)
        assert r.text == out + text[upto:]
