"""From text to a bound query: syntax, names, printed plans."""
