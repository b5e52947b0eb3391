import random
from collections import defaultdict

import pytest

from larkspur.llm import pii
from larkspur.llm.common import Scratch

from .test_pii import luhn


def card(rng):
    first = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    whole = next(first + str(d) for d in range(10) if luhn(first + str(d)))
    return " ".join(whole[i : i + 4] for i in range(0, 16, 4))


def test_unseen_identifiers_with_spaces_are_found(spark):
    rng = random.Random(5)
    data = []
    for i in range(60):
        data.append((i, f"please call hotline: +1 ({rng.randint(200, 999)}) 555-{i:04d} now"))
        data.append((100 + i, f"it was paid by visa {card(rng)}, room {i} of the house"))
        data.append((200 + i, f"or write to mailbox: user{i}@host{i}.org today"))
    unseen = {
        900: ("ring the hotline: (243) 555 5526, please", "(243) 555 5526"),
        901: ("they paid by visa 4111 1111 1111 1112 again", "4111 1111 1111 1112"),
        902: ("then write to mailbox: jane(at)host.org again", "jane(at)host.org"),
        903: ("the mailbox: jane [at] host.org is open", "jane [at] host.org"),
        904: ("paid by visa 4111 1111 1111 1112 20 30 40", "4111 1111 1111 1112 20"),
        905: ("\U0001f600 a@b.co then hotline: 0243 555 5526.", "0243 555 5526"),
        906: ("hotline: 0243-555-5526 x", "0243-555-5526"),
    }
    data += [(k, t) for k, (t, _) in unseen.items()] + [(950, "the hotline: is closed, room 77 and 4111 1111 1111 1112 too"), (951, "see hotline: 12 34 of the list")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    for i in range(60):
        assert [x.k for x in found[i].base] == [3] and [x.k for x in found[100 + i].base] == [2]
    for k, (text, inst) in unseen.items():
        assert found[k].text == text
        assert [text[x.s : x.e] for x in found[k].spans if x not in found[k].base] == [inst], (k, found[k].spans)
    assert not found[950].spans and not found[951].spans


def brute_patterns(rows, support, confidence):
    """Trusted patterns by definition, on dictionaries."""
    edges = {(p, i, s): frozenset(k) for p, i, s, k in rows}
    trusted = {}
    while True:
        score = {}
        for (p, i, s), kinds in edges.items():
            for k in kinds if s is None else ():
                if (p, k) in trusted:
                    score[i, k] = max(score.get((i, k), 0), trusted[p, k])
        new, by = {}, defaultdict(list)
        for (p, i, s), kinds in edges.items():
            by[p].append((i, s, kinds))
        for p, of in by.items():
            for k in pii.KINDS:
                got = [1.0 if s == k else score.get((i, k), 0.0) if s is None and k in kinds else 0.0 for i, s, kinds in of]
                if sum(x >= confidence for x in got) >= support and sum(got) >= confidence * len(got) - 1e-12:
                    new[p, k] = sum(got) / len(got)
        if set(new) == set(trusted):
            return set(new)
        trusted = new


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(30):
        kind = rng.choice(pii.KINDS)
        seeds, others = rng.choice([(8, 0), (8, 1), (0, 8), (3, 6), (1, 3), (6, 6)])
        rows += [(f"p{p}", f"{kind}{rng.randrange(12)}", kind, []) for _ in range(seeds)]
        rows += [(f"p{p}", f"u{kind}{rng.randrange(10)}", None, [kind]) for _ in range(others)]
        rows += [(f"p{p}", f"x{rng.randrange(99)}", None, []) for _ in range(rng.choice([0, 0, 1]))]
    df = spark.createDataFrame(rows, "pattern string, inst string, seed string, kinds array<string>")
    got = pii.learned_patterns(df, Scratch(spark, "t"), support=4, confidence=0.8)
    assert {(r.pattern, r.kind) for r in got.collect()} == brute_patterns(rows, 4, 0.8)


def test_discovered_instances_make_patterns_of_their_own(spark):
    """Phones without a plus are found behind "hotline:", trusted for its seeds; those behind "desk:" are trusted for them alone."""
    rng = random.Random(4)
    numbers = [f"0{rng.randint(200, 999)} 555 {k:04d}" for k in range(30)]
    data = [(i, f"call hotline: +1 ({rng.randint(200, 999)}) 555-{i:04d} now") for i in range(300)]
    data += [(1000 + i, f"or hotline: {x}, please") for i, x in enumerate(numbers)] + [(2000 + i, f"the front desk: {x}, too") for i, x in enumerate(numbers)]
    data += [(3000, "the front desk: 0999 777 1234 now"), (3001, "the back office: 0999 777 1235 now")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert [found[3000].text[x.s : x.e] for x in found[3000].spans] == ["0999 777 1234"] and not found[3001].spans
    assert all(len(found[2000 + i].spans) == 1 for i in range(30))


def test_long_words_are_whole_contexts(spark):
    """A word of more than 64 characters before an instance is no shorter word's context."""
    tail = "y" * 64
    data = [(i, f"code {'x' * 10}{tail} user{i}@host{i}.org") for i in range(40)] + [(100, f"code {'z' * 30}{tail} jane(at)host.org"), (101, f"code {'x' * 10}{tail} jane(at)host.org")]
    found = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert not found[100].spans and len(found[101].spans) == 1


def test_covering_long_texts(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abc \n\U0001f600é") for _ in range(5_000))
    spans = sorted({(a := rng.randrange(5_000), rng.randrange(4), min(5_000, a + rng.choice([1, 3, 50, 2_500]))) for _ in range(15)} | {(1024, 0, 2048), (4_999, 1, 5_000)})
    df = spark.createDataFrame([(text, spans), (text, []), (None, None), ("x" * 1024, [(0, 0, 1024)]), ("x" * 2_000_000, [(5 * k, 1, 5 * k + 2) for k in range(20_000)])], f"text string, spans {pii.SPANS}")
    got = [r.text for r in pii.mask_pii(df).collect()]
    want, upto = "", 0
    for s, k, e in spans:
        want += text[upto:s] if s > upto else ""
        want += pii.MASK[pii.KINDS[k]] if s >= upto else ""
        upto = max(upto, e)
    assert got[:4] == [want + text[upto:], text, None, "<EMAIL>"]
    assert got[4] == "<IP>xxx" * 20_000 + "x" * 1_900_000


def test_clashing_columns_and_repeated_rows(spark):
    data = [(1, "mail a@b.co", "x", "y"), (1, "mail a@b.co", "x", "y"), (None, None, None, None)]
    got = pii.find_pii(spark.createDataFrame(data, "doc_id long, text string, spans string, seeds string"), Scratch(spark, "t"))
    assert sorted(map(len, (r.spans or [] for r in got.collect()))) == [0, 1, 1] and "seeds" not in got.columns
