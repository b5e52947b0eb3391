"""From SQL text to DataFrames: lexer, parser, binder, join order."""
