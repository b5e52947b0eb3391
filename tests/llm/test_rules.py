import math
import random
import re
import unicodedata
from collections import Counter

from larkspur.llm import rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = [sum(a * math.log2(a / c) for a, c in zip(x, m, strict=True) if a > 0) for x in (p, q)]
    return math.sqrt(max(0, sum(kl) / 2))


def classes(t):
    out = dict.fromkeys(rules.CLASSES, 0)
    for c in t:
        if c in " \t\n\x0b\x0c\r":
            k = "space"
        elif c in "#*$%&|<>":
            k = "symbol"
        elif c in ".,;:!?'\"()-":
            k = "mark"
        elif "0" <= c <= "9":
            k = "digit"
        else:
            k = {"Ll": "lower", "Lu": "upper"}.get(unicodedata.category(c), "rest")
        out[k] += 1
    return [out[k] for k in rules.CLASSES]


LISTS = {"de": "der die und in den von zu das mit sich des auf für ist im es".split(), "en": "the of and to in a is that for it was on are with as be".split(), "fr": "de la le et les des en un du une que est pour qui dans il".split(), "est": "ja on ei ta see et oli ka".split()}


def tag(lang):
    found = re.fullmatch("([a-z]{2,3})([-_].*)?", (lang or "").strip(" ").lower())
    return found[1] if found else rules.OTHER


def common(data):
    """The most frequent words of every language, by plain counts."""
    counts = {}
    for _, t, lang, *_ in data:
        if tag(lang) != rules.OTHER:
            counts.setdefault(tag(lang), Counter()).update(w.lower() for w in WORD.findall(t or "") if w.lower().isalpha() and len(w) <= rules.LETTERS)
    return {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]] for k, c in counts.items()}


def rows():
    rng = random.Random(6)
    out = [(0, None, "en"), (1, "", None), (2, " \n\t", "en"), (3, "one two", "de"), (4, "a b c d e f g h", "en"), (5, "a b c d e f g h " * 2, "en"), (6, "\x1cx\x85 y z \x0b\x0cw\r", "fr"), (7, "line\nline\n\n \nother\nline", "en"), (8, "word " * 30_000, "en")]
    for i in range(9, 160):
        lang = rng.choice(["en", "de", "fr", "EN-us", "est", "no language", None])
        words = LISTS.get(tag(lang), ["foo", "bar"]) + ["Lorem", "ipsum", "dolor", "é#b", "x|y", "12", "end."]
        t = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        if i % 5 == 0:
            t = [w.upper() + "!!" for w in t]
        if i % 3 == 0 and len(t) > 30:
            k = rng.randint(0, 10)
            t += t[k : k + rng.randint(5, 20)]
        out.append((i, rng.choice([" ", "  ", "\n"]).join(t) + rng.choice(["", "\n", " "]), lang))
    out += [out[20], (None, out[30][1], "en")]
    return [(d, t, lang, "s", "x") for d, t, lang in out]


def test_equals_brute_force(spark):
    data = rows()
    got = rules.quality_rules(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = {d: base(t) for d, t, *_ in data}
    for r in got:
        assert tuple(r[n] for n in names) == want[r.doc_id], r.doc_id
    group, lists = {d: tag(lang) for d, _, lang, *_ in data}, common(data)
    sums, hits, total = {}, {}, {}
    counted = {}
    for k, (d, t, *_) in enumerate(data):
        lang = group[d]
        c = classes(t or "")
        h = [sum(w.lower() == x for w in WORD.findall(t or "")) for x in lists.get(lang, [])]
        counted[d] = (c, h, base(t)[0])
        if not base(t)[5]:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * 7), c, strict=True)]
            hits[lang] = [a + b for a, b in zip(hits.get(lang, [0] * len(h)), h, strict=True)]
            total[lang] = total.get(lang, 0) + base(t)[0]
    for r in got:
        c, h, n = counted[r.doc_id]
        lang = group[r.doc_id]
        far = False
        if sum(c) and lang in sums:
            d = js([x / sum(c) for x in c], [x / sum(sums[lang]) for x in sums[lang]])
            assert abs(d - r.char_distance) < 1e-9
            far |= sum(c) >= 200 and d > 0.3
        if h and n and lang in hits:
            p, q = [x / n for x in h], [x / total[lang] for x in hits[lang]]
            d = js(p + [1 - sum(p)], q + [1 - sum(q)])
            assert abs(d - r.word_distance) < 1e-6
            far |= n >= 60 and d > 0.29
        assert r.kept == (not r.base_failed and not far)
    assert any(not r.kept and not r.base_failed for r in got) and any(r.kept for r in got)


def test_languages_are_told_apart_by_their_whole_name(spark):
    """Estonian is no Spanish, a region changes nothing, and of equally frequent words the first counts."""
    data = [(1, "b a a", " EST "), (2, "la la de", "es"), (3, "de en", "es-MX"), (4, "x y!", "e"), (5, None, "fr"), (6, "Z z", "frr")]
    got = {r.lang: r.common for r in rules.common_words(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert got == {"est": ["a", "b"], "es": ["de", "la", "en"], "frr": ["z"]}


def test_very_long_text(spark):
    text = "word other " * 300_000
    (r,) = rules.quality_rules(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")).collect()
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (600_000, 2_700_000, 600_000) and r.base_failed


def test_empty_and_plain(spark):
    df = rules.quality_rules(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan
