"""Types, scalar expressions and sketches."""
