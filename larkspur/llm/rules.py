"""Quality rules: counting rules, then the divergence from a language's own distributions.

Everything is built of DataFrame functions; a row is handled where it is read.

* Base rules: repeated 8-word windows are found by hashing every window and
  sorting the hashes of a text that has equal ones.
* The method compares two histograms of a text with those of its language: the
  classes of its characters, and its share of the language's common words.  The
  common words are the most frequent of all words of the language's texts, the
  references sums over all of them that pass the base rules.  A text too far
  away (Jensen-Shannon distance) fails, if it is long enough for its histogram
  to mean something.

A language is named by two or three letters before any region, so there are
at most 26^2 + 26^3 besides ``other``: tables by language are small enough to be
broadcast at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held, read_table

OTHER = "other"
CLASSES = ["lower", "upper", "digit", "space", "symbol", "mark", "rest"]
WINDOW = 8  # a power of two
COMMON = 16  # words in a language's histogram, besides all others
LETTERS = 8  # of a common word at most; longer ones are no function words
_SPACE = " \\t-\\r"


def _counts(text: Column, other: Column) -> dict[str, Column]:
    """Characters by class, given the text and what is left of it without lower case letters; every character is in one."""

    def only(kept: str) -> Column:
        return F.length(F.regexp_replace(other, f"[^{kept}]+", ""))

    return {"lower": F.length(text) - F.length(other), "upper": only("\\p{Lu}"), "digit": only("0-9"), "space": only(_SPACE), "mark": only(".,;:!?'\"()\\-"), "n_symbols": only("#*$%&|<>")}


def _language() -> Column:
    """The letters that name a row's language, or ``other``."""
    named = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,3})([-_].*)?$", 1)
    return F.when(F.length(named) > 0, named).otherwise(F.lit(OTHER))


def _worded(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` and ``words`` of every row; null texts have none."""
    spaces = " \t\n\x0b\x0c\r"
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _language().alias("lang"))
    trimmed = F.expr(f"trim(BOTH '{''.join(spaces.encode('unicode_escape').decode().replace('x0b', 'u000B').replace('x0c', 'u000C'))}' FROM text)")
    df = df.withColumn("_t", trimmed)
    return df.withColumn("words", F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", f"[{_SPACE}]+")))


def common_words(docs: DataFrame) -> DataFrame:
    """``lang, common``: the ``COMMON`` most frequent words of every language (lower case, up to ``LETTERS`` letters; of equals the first), most frequent first.

    Words are counted where they are read; of a language, the partial ranks keep
    a few rows of every partition for the last one.
    """
    word = f"(?<![^{_SPACE}])\\p{{L}}{{1,{LETTERS}}}(?![^{_SPACE}])"
    # Exploded where it is found: of a column, the optimizer would search the text once more to leave out empty ones.
    found = docs.select(_language().alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0))).alias("w"))
    counts = found.where(F.col("lang") != OTHER).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("k", rank).where(F.col("k") <= COMMON)
    return top.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("common"))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """Counts of every whole text of ``docs(doc_id, text, lang, ..)``; null texts have no words."""
    longest = F.array_max(F.transform("common", F.octet_length)) + 2  # lower case may be a little shorter than upper case
    df = _worded(docs).join(F.broadcast(common.withColumn("_longest", longest)), "lang", "left")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    df = df.withColumn("_lines", lines).withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    # Hashes of 2, 4 and 8 words, each of two halves side by side.
    df = df.withColumn("_w", F.when(F.size("_h") > WINDOW, F.col("_h")))
    half = 1
    while half < WINDOW:
        left = F.size("_w") - half
        df = df.withColumn("_w", F.zip_with(F.slice("_w", F.lit(1), left), F.slice("_w", F.lit(half + 1), left), lambda a, b: F.xxhash64(a, b)))
        half *= 2
    found = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(found, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    # Windows equal to a neighbour in hash order, then the length of the union of [i, i + 8).
    twice = F.filter("_s", lambda e, k: (F.get("_s", k - 1)["x"] == e["x"]) | (F.get("_s", k + 1)["x"] == e["x"]))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    step = "(acc, i) -> named_struct('e', i + {w}, 'n', acc.n + i + {w} - greatest(acc.e, i))".format(w=WINDOW)
    repeated = F.expr(f"coalesce(aggregate(_at, named_struct('e', 0, 'n', 0), {step}, acc -> acc.n), 0)")
    df = df.withColumn("_place", F.filter(F.transform("words", lambda w: F.when(F.octet_length(w) <= F.col("_longest"), F.array_position("common", F.lower(w)))), lambda k: k > 0))
    hits = F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: F.size(F.filter("_place", lambda x: x == k)))
    df = df.withColumn("_other", F.regexp_replace("text", "\\p{Ll}+", ""))
    counts = _counts(F.col("text"), F.col("_other"))
    df = df.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - counts["space"]).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.length("text").alias("n_chars"),
        *[v.cast("long" if k == "n_symbols" else "int").alias(k) for k, v in counts.items()],
        F.coalesce(F.when(F.col("common").isNotNull(), held(hits, "_place")), F.array().cast("array<int>")).alias("hits"),
    )
    df = df.withColumn("symbol", F.col("n_symbols").cast("int")).withColumn("rest", F.col("n_chars") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("space") - F.col("symbol") - F.col("mark"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts / total to a reference; null if the total is 0 or there is no reference."""
    p = F.transform(counts, lambda x: x / F.nullif(total, F.lit(0)))
    pairs = F.zip_with(p, reference, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    sums = F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + term(e["x"], e["y"]) + term(e["y"], e["x"]))
    return F.sqrt(F.greatest(sums / 2, F.lit(0.0)))


def references(rows: DataFrame) -> DataFrame:
    """``lang, by_class, by_word``: shares of character classes, and of common words with all others last (null without any)."""
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in [*CLASSES, "n_words"]] + [F.sum(F.get("hits", F.lit(k)).cast("long")).alias(f"w{k}") for k in range(COMMON)]
    good = rows.where(~F.col("base_failed")).groupBy("lang").agg(*sums, F.max(F.size("hits")).alias("_k"))
    chars, words = F.greatest(sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])), F.lit(1)), F.greatest("n_words", F.lit(1))
    shares = F.transform(F.slice(F.array(*[f"w{k}" for k in range(COMMON)]), F.lit(1), F.col("_k")), lambda x: x / words)
    rest = 1 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return good.select("lang", F.array(*[F.col(c) / chars for c in CLASSES]).alias("by_class"), F.when(F.col("_k") > 0, F.concat(shares, F.array(rest))).alias("by_word"))


def quality_rules(docs: DataFrame, char_limit: float = 0.3, word_limit: float = 0.29, least_chars: int = 200, least_words: int = 60) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance``.

    Null texts count as empty (and fail by length); a text whose language is
    null or no language's name is compared by its characters with the other
    such texts.  Repeated rows and null ids stay; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = Scratch(docs.sparkSession, "rules").keep(features(docs, common_words(docs)))
    rest = F.col("n_words") - F.aggregate("hits", F.lit(0), lambda a, x: a + x)
    counted = F.when(F.size("hits") > 0, F.concat(F.transform("hits", lambda x: x.cast("double")), F.array(rest.cast("double"))))
    by_class = F.array(*[F.col(c).cast("double") for c in CLASSES])
    rows = rows.join(F.broadcast(references(rows)), "lang", "left")
    rows = rows.withColumn("char_distance", _distance(by_class, F.col("n_chars"), F.col("by_class"))).withColumn("word_distance", _distance(counted, F.col("n_words"), F.col("by_word")))
    far = ((F.col("n_chars") >= least_chars) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= least_words) & (F.col("word_distance") > word_limit))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _sql() -> str:
    """The same rules in DuckDB's SQL, written from the same constants."""
    only = {"lower": "\\p{Ll}", "upper": "\\p{Lu}", "digit": "0-9", "space": _SPACE, "symbol": "#*$%&|<>", "mark": ".,;:!?''\"()\\-"}
    counts = ", ".join(f"length(regexp_replace(text, '[^{c}]+', '', 'g')) AS {k}" for k, c in only.items())
    rest = "n_chars - " + " - ".join(only)
    vector = f"[{', '.join(only)}, {rest}]"
    sums = ", ".join(f"sum({c})" for c in [*only, rest])

    def distance(p: str, q: str) -> str:
        term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END"
        both = term.format(a="z[1]", b="z[2]") + " + " + term.format(a="z[2]", b="z[1]")
        return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {both})) / 2, 0.0))"

    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN regexp_full_match(lower(trim(lang)), '[a-z]{{2,3}}([-_].*)?') THEN regexp_extract(lower(trim(lang)), '^[a-z]+', 0) ELSE '{OTHER}' END AS lang FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[{_SPACE}]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM d
), cw AS (
  SELECT lang, list(x ORDER BY k) AS common FROM (
    SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, x) AS k
    FROM (SELECT lang, lower(unnest(words)) AS x FROM w WHERE lang <> '{OTHER}') WHERE regexp_full_match(x, '\\p{{L}}{{1,{LETTERS}}}') GROUP BY lang, x
  ) WHERE k <= {COMMON} GROUP BY lang
), win AS (
  SELECT rid, u.i AS i, array_to_string(words[u.i : u.i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) u(i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, sum(least({WINDOW}, nxt - i)) AS n FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + {WINDOW}) AS nxt FROM dup) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, w.lang, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, length(text) AS n_chars, {counts},
    list_transform(coalesce(common, []), lambda c: len(list_filter(words, lambda x: lower(x) = c))) AS hits
  FROM w LEFT JOIN cov ON cov.rid = w.rid LEFT JOIN cw ON cw.lang = w.lang
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
), rc AS (
  SELECT lang, list_transform([{sums}], lambda x: x / greatest(sum(n_chars), 1)) AS q, sum(n_words) AS n FROM b WHERE NOT base_failed GROUP BY lang
), rh AS (
  SELECT lang, k, sum(h) AS h FROM (SELECT lang, unnest(hits) AS h, generate_subscripts(hits, 1) AS k FROM b WHERE NOT base_failed) GROUP BY lang, k
), rw AS (
  SELECT rh.lang, list(h / greatest(rc.n, 1) ORDER BY k) AS q FROM rh JOIN rc ON rc.lang = rh.lang GROUP BY rh.lang
), s AS (
  SELECT b.*, CASE WHEN n_chars >= 200 THEN {distance(f"list_transform({vector}, lambda x: x / n_chars)", "rc.q")} END AS cd,
    CASE WHEN n_words >= 60 AND len(hits) > 0 THEN {distance("list_append(list_transform(hits, lambda x: x / n_words), 1 - list_sum(hits) / n_words)", "list_append(rw.q, 1 - list_sum(rw.q))")} END AS wd
  FROM b LEFT JOIN rc ON rc.lang = b.lang LEFT JOIN rw ON rw.lang = b.lang
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(cd > 0.3, false) AND NOT coalesce(wd > 0.29, false) AS kept
FROM s
"""


OP6_SQL = _sql()
