"""A small command line: statements end with ``;``; also exit, explain, show, analyze, stats, compact and vacuum."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import EngineError
from .plans.lexer import tokenize


def statements(text: str) -> tuple[list[str], str]:
    """Complete statements of a text, and the rest; semicolons in strings do not count."""
    out, start, quote, skip = [], 0, "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\" and quote == "'"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ";":
            out.append(text[start : i + 1].strip())
            start = i + 1
    return out, text[start:]


def run(engine: Engine, statement: str) -> str:
    """What the shell prints for a statement."""
    words = statement.rstrip(";").split()
    try:
        if words[:1] == ["explain"]:
            return engine.explain(statement.strip()[len("explain") :])
        if words[:1] == ["show"]:
            return "\n".join(f"{t.name}({', '.join(c[0] for c in t.columns)})" for t in engine.catalog.tables.values())
        if words[:1] in (["analyze"], ["stats"]) and len(words) == 2:
            name = str(tokenize(words[1])[0].value)
            found = engine.analyze(name) if words[0] == "analyze" or name not in engine.stats else engine.stats[name]
            return "\n".join([f"{found.rows} rows", *[f"{c}: {s.low} to {s.high}, about {s.distinct} distinct" for c, s in found.columns.items()]])
        if words[:1] == ["compact"] and len(words) == 2:
            return f"{engine.compact(str(tokenize(words[1])[0].value))} segments merged"
        if words == ["vacuum"]:
            return f"{engine.vacuum()} folders deleted"
        return engine.execute(statement).show()
    except EngineError as e:
        return f"error: {e}"


def main() -> None:
    engine = Engine(SparkSession.builder.getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else None)
    rest = ""
    for line in sys.stdin:
        if line.strip() in ("exit", "quit"):
            return
        done, rest = statements(rest + line)
        for s in done:
            print(run(engine, s))


if __name__ == "__main__":
    main()
