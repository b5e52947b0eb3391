"""Personal data: fixed patterns, and contextual patterns bootstrapped from them.

Built of DataFrame functions only.

Base spans.  A text is split at the matches of a kind's pattern; lengths of the
pieces and matches give positions in code points.  Running sums inside a row
work in blocks of sqrt(n), so a text with very many matches stays feasible.
The patterns are rewritten so that a text is scanned in linear time: a match
starts where a run of its characters starts, or where the last match ended
(``\\G``), and repeats are possessive (no backtracking, no deep recursion).

Contextual spans.  Base spans are seed instances, blanks included; what they
leave of the text is searched for unknown ones: runs of number groups with one
blank between them (a lone digit is no group), words around an "(at)", and tokens
with a digit or an @.  The one and the two words before an instance, on its line
and behind the instance before, are lexical patterns.

Patterns and instances form a graph that is scored in rounds.  A seed scores 1
for its kind; an unknown instance that has a kind's loose shape scores the best
confidence among its trusted patterns; any other scores 0.  A pattern's
confidence is the mean score of its distinct instances, its support the number
of those that score ``confidence`` or more.  Patterns with enough of both are
trusted, so what they discover counts as seeds for further patterns, also for
such that no seed has; rounds go on until no pattern is added.  Trusted patterns
finally label the unknown instances behind them that have the kind's loose
shape; of a run, the longest beginning that has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, read_table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
_WS = " \\t-\\r"
#: The kinds' patterns; equal in matches to the plain ones, but linear.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be possible.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_GROUP = rf"(?![0-9](?:[{_WS}]|$))[+(]*+[0-9][0-9().+/-]*+(?=[,;:!?\]\"']*+(?:[{_WS}]|$))"
_AT = r"[(\[][aA][tT][)\]]"
INSTANCE = rf"(?<![^{_WS}])(?:{_GROUP}(?:\x20{_GROUP})++|[^{_WS}]+?\x20?{_AT}\x20?[^{_WS}]++|[^{_WS}0-9@]*+[0-9@][^{_WS}]*+)"
#: Loose shapes of what a trusted pattern may label.
SHAPES = {"email": r"^\S+(@| ?\(at\) ?| ?\[at\] ?)\S+$", "ip": r"^[0-9a-fA-F]{1,4}([.:][0-9a-fA-F]{1,4}){3,7}$", "card": r"^([^0-9]*[0-9]){12,19}[^0-9]*$", "phone": r"^([^0-9]*[0-9]){7,15}[^0-9]*$"}
MASK = {k: f"<{k.upper()}>" for k in KINDS}


def with_scan(df: DataFrame, values: str, out: str, op: str = "sum") -> DataFrame:
    """Add ``out``, the inclusive running sum (or maximum) of the long array ``values``; empty for null.

    Blocks of sqrt(n) elements: appending to arrays then costs n * sqrt(n)
    instead of n * n.  The steps are columns of their own, as a lambda would
    evaluate an expression anew for every element.
    """
    both = "acc.t + x" if op == "sum" else "greatest(acc.t, x)"
    whole = "a + x" if op == "sum" else "greatest(a, x)"
    zero = "0L" if op == "sum" else "-1L"
    grow = f"(acc, x) -> named_struct('t', {both}, 'o', concat(acc.o, array({both})))"
    df = df.withColumn("_n", F.expr(f"coalesce(size({values}), 0)")).withColumn("_k", F.expr("cast(ceil(sqrt(_n)) as int)"))
    df = df.withColumn("_seq", F.expr("if(_n > 0, sequence(0, cast(ceil(_n / _k) as int) - 1), cast(array() as array<int>))"))
    df = df.withColumn("_sum", held(F.expr(f"transform(_seq, b -> aggregate(slice({values}, b * _k + 1, _k), {zero}, (a, x) -> {whole}))"), values, "_seq"))
    df = df.withColumn("_off", F.expr(f"aggregate(_sum, named_struct('t', {zero}, 'o', array({zero})), {grow}, acc -> acc.o)"))
    made = f"flatten(transform(_seq, b -> aggregate(slice({values}, b * _k + 1, _k), named_struct('t', element_at(_off, b + 1), 'o', cast(array() as array<bigint>)), {grow}, acc -> acc.o)))"
    return df.withColumn(out, F.coalesce(held(F.expr(made), values, "_off", "_seq"), F.array().cast("array<bigint>"))).drop("_n", "_k", "_seq", "_sum", "_off")


FOUND = "array<struct<m:string,e:bigint,one:string,two:string>>"


def _located(df: DataFrame, pattern: str, possible: Column, out: str, contexts: bool) -> DataFrame:
    """Add ``out``: structs ``m`` (match), ``e`` (its end in code points), ``one`` and ``two`` (the last words before it and behind the match before; empty if there are none)."""
    found = F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("_m", F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size("_m"))))
    df = df.withColumn("_u", F.zip_with("_p", "_m", lambda p, m: (F.length(p) + F.length(m)).cast("long")))
    df = with_scan(df, "_u", "_e")
    word = rf"(?<![^{_WS}])[^{_WS}]++"
    words = lambda i, pattern: F.regexp_extract(F.get("_p", i), rf"({pattern})[ \t]*$", 1) if contexts else F.lit("")
    zipped = F.transform("_m", lambda m, i: F.struct(m.alias("m"), F.get("_e", i).alias("e"), words(i, word).alias("one"), words(i, rf"{word}[ \t]++{word}").alias("two")))
    none = F.array().cast(FOUND)
    return df.withColumn(out, F.coalesce(held(zipped, "_p", "_e"), none)).drop("_m", "_p", "_u", "_e")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _spans(kind: str, found: str) -> Column:
    def span(x: Column) -> Column:
        return F.struct((x["e"] - F.length(x["m"])).alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))

    return F.transform(F.filter(found, lambda x: valid(kind, x["m"])), span)


def _seeds(kind: str, found: str) -> Column:
    return F.transform(F.filter(found, lambda x: valid(kind, x["m"])), lambda x: F.struct(F.lit(kind).alias("seed"), x["m"].alias("m"), x["one"].alias("one"), x["two"].alias("two")))


SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def base_spans(docs: DataFrame, text: str = "text", seeds: bool = False) -> DataFrame:
    """``docs`` with ``base``: sorted spans (start ``s``, kind number ``k``, end ``e``) of every whole text (null: none).

    With ``seeds`` also ``seeds``: kind, text and the words before of every span.
    """
    df = docs if text == "text" else docs.withColumn("text", F.col(text))
    for kind in KINDS:
        possible = F.col("text").rlike("[0-9]") if NEEDED[kind] is None else F.contains(F.col("text"), F.lit(NEEDED[kind]))
        df = _located(df, PATTERNS[kind], possible, "_f", seeds)
        df = df.withColumn(f"_{kind}", _spans(kind, "_f"))
        if seeds:
            df = df.withColumn(f"_of_{kind}", _seeds(kind, "_f"))
        df = df.drop("_f")
    if seeds:
        df = df.withColumn("seeds", F.concat(*[F.col(f"_of_{k}") for k in KINDS])).drop(*[f"_of_{k}" for k in KINDS])
    return df.withColumn("base", F.sort_array(F.concat(*[F.col(f"_{k}") for k in KINDS])).cast(SPANS)).drop(*[f"_{k}" for k in KINDS])


def _instances(df: DataFrame) -> DataFrame:
    """Add ``found``: unknown instances beside the base spans, their ends, and the words before them."""
    blank = lambda x, upto: F.repeat(F.lit("\n"), (x["e"] - F.greatest(x["s"], upto)).cast("int"))
    df = _covered(df.withColumn("_whole", F.col("text")), "base", blank)
    df = _located(df, INSTANCE, F.col("text").rlike(rf"[0-9@]|{_AT}"), "found", True)
    return df.withColumn("text", F.col("_whole")).drop("_whole")


def _fitting(inst: Column, shape: str) -> Column:
    """The longest beginning of whole groups that has the shape; every group has a digit, so no shape takes more than 19."""
    groups = F.slice(F.split(inst, " "), 1, 20)
    begun = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.regexp_replace(F.array_join(F.slice(groups, F.lit(1), n), " "), "[.,;:!?)\\]\"']+$", ""))
    return F.get(F.filter(begun, lambda x: x.rlike(shape)), F.lit(0))


def _fits(inst: Column) -> dict[str, Column]:
    """What of an unknown instance has each kind's loose shape; null if nothing has."""
    return {k: F.when(inst.rlike(SHAPES[k]), inst) if k == "email" else _fitting(inst, SHAPES[k]) for k in KINDS}


def learned_patterns(rows: DataFrame, scratch: Scratch, support: int = 20, confidence: float = 0.9, rounds: int = 50) -> DataFrame:
    """Trusted ``(pattern, kind)`` of ``rows(pattern, inst, seed, kinds)``, by rounds over the graph.

    ``seed`` is the kind of a seed, else null; ``kinds`` are the kinds whose
    shape an unknown instance has.  Only patterns that could be trusted if all
    instances of their kind's shape were discovered take part in the rounds,
    which end when no pattern is added (at the latest after ``rounds``).
    """
    edges = scratch.keep(rows.select("pattern", "inst", "seed", "kinds").distinct())
    each = edges.select("pattern", "inst", "seed", F.explode_outer(F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.col("kinds"))).alias("kind"))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= support)
    able = each.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("most"), F.count("seed").alias("seeds"))
    able = able.join(totals, "pattern").where((F.col("most") >= support) & (F.col("most") >= confidence * F.col("total")))
    able = scratch.keep(able.select("pattern", "kind", "seeds", "total"))
    graph = scratch.keep(each.where("seed is null and kind is not null").join(able.select("pattern", "kind"), ["pattern", "kind"]).select("pattern", "kind", "inst"))
    of = able.select("pattern", "kind", "total", F.col("seeds").alias("support"), F.col("seeds").cast("double").alias("mass"))
    trusted, known = None, -1
    for _ in range(rounds):
        scored = of.withColumn("confidence", F.col("mass") / F.col("total"))
        trusted = scratch.keep(scored.where((F.col("support") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"))
        now = trusted.count()
        if now == known or not now:
            break
        known = now
        scores = graph.join(trusted, ["pattern", "kind"]).groupBy("inst", "kind").agg(F.max("confidence").alias("score"))
        found = graph.join(scores, ["inst", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"), F.count(F.lit(1)).alias("n"))
        of = able.join(found, ["pattern", "kind"], "left").select("pattern", "kind", "total", (F.col("seeds") + F.coalesce("n", F.lit(0))).alias("support"), (F.col("seeds") + F.coalesce("gained", F.lit(0.0))).alias("mass"))
    return trusted.select("pattern", "kind")


def find_pii(docs: DataFrame, scratch: Scratch, support: int = 20, confidence: float = 0.9, rounds: int = 50) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start ``s``, kind ``k``, end ``e``), sorted.

    ``spans`` holds all base spans and those the learned contexts add beside
    them.  Null and empty texts have none; repeated rows and null ids are
    handled by row (equal instances behind one pattern count once); clashing
    columns are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("base", "spans", "found", "seeds", "_rid")
    rows = _instances(base_spans(docs, seeds=True)).withColumn("_rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows)  # fixes the row numbers
    unknown = rows.select("_rid", F.explode("found").alias("f")).select("_rid", "f.*", F.lit(None).cast("string").alias("seed"))
    known = rows.select("_rid", F.explode("seeds").alias("f")).select("_rid", "f.m", F.lit(None).cast("long").alias("e"), "f.one", "f.two", "f.seed")

    def named(each: DataFrame) -> DataFrame:
        inst = F.lower(F.regexp_replace("m", "[.,;:!?)\\]\"']+$", ""))
        ps = F.array(F.concat(F.lit("1 "), F.lower("one")), F.concat(F.lit("2 "), F.lower(F.regexp_replace("two", "[ \t]+", " "))))
        return each.select("_rid", "m", "e", "seed", inst.alias("inst"), F.explode(ps).alias("pattern")).where("length(pattern) > 3 and not pattern rlike '[0-9@]{2}'")

    fits = _fits(F.col("inst"))
    behind = named(unknown)
    none = F.array().cast("array<string>")
    kinds = F.filter(F.array(*[F.when(fits[k].isNotNull(), F.lit(k)) for k in KINDS]), lambda k: k.isNotNull())
    graph = behind.select("pattern", "inst", "seed").distinct().withColumn("kinds", kinds).unionByName(named(known).select("pattern", "inst", "seed", none.alias("kinds")))
    trusted = learned_patterns(graph, scratch, support, confidence, rounds)
    number = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    fit = F.coalesce(*[F.when(F.col("kind") == k, fits[k]) for k in KINDS])
    new = behind.join(trusted, "pattern").withColumn("fit", fit).where("fit is not null")
    start = F.col("e") - F.length("m")
    added = new.select("_rid", F.struct(start.alias("s"), number.alias("k"), (start + F.length("fit")).alias("e")).alias("x")).groupBy("_rid").agg(F.collect_set("x").alias("added"))
    both = rows.drop("found", "seeds").join(added, "_rid", "left")
    return both.withColumn("spans", F.coalesce(F.when(F.size("added") > 0, F.sort_array(F.concat("base", "added"))), F.col("base"))).drop("added", "_rid")


CHUNK = 1024


def _between(chunks: str, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given as chunks of ``CHUNK``; touches the chunks it needs only."""
    a, b = (F.floor(x / CHUNK).cast("int") for x in (start, end))
    at, upto = ((x - k * CHUNK).cast("int") for x, k in ((start, a), (end, b)))
    within = F.substring(F.get(chunks, a), at + 1, (end - start).cast("int"))
    across = F.concat(F.substring(F.get(chunks, a), at + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(chunks, b), F.lit(1), upto), F.lit("")))
    return F.when(start >= end, F.lit("")).when(a == b, within).otherwise(across)


def _covered(df: DataFrame, spans: str, cover: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with every one of ``spans`` in ``text`` replaced by ``cover(span, end of those before it)``, which sees the rest of an overlap only."""
    some = F.size(spans) > 0
    df = df.withColumn("_ends", F.transform(spans, lambda x: x["e"]))
    df = with_scan(df, "_ends", "_max", "max").withColumn("_c", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def before(x: Column, i: Column) -> Column:
        upto = F.coalesce(F.get("_max", i - 1), F.lit(0))
        return F.concat(_between("_c", upto, x["s"]), F.when(x["e"] > upto, cover(x, upto)).otherwise(F.lit("")))

    tail = _between("_c", F.element_at("_max", -1), F.length("text"))
    made = F.concat(F.array_join(F.transform(spans, before), ""), tail)
    return df.withColumn("text", F.when(some, held(made, "_c", "_max")).otherwise(F.col("text"))).drop("_ends", "_max", "_c")


def mask_pii(found: DataFrame) -> DataFrame:
    """Replace every span of ``found(text, spans, ..)`` in ``text`` by its kind's mask; overlapping spans share one."""
    masks = F.array(*[F.lit(MASK[k]) for k in KINDS])
    return _covered(found, "spans", lambda x, upto: F.when(x["s"] >= upto, F.get(masks, x["k"])).otherwise(F.lit("")))


def _of_kind(spans: str, number: int) -> Column:
    return F.filter(spans, lambda x: x["k"] == number)


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_pii(docs, Scratch(spark, "pii"))
    counts = [F.size(_of_kind("base", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
