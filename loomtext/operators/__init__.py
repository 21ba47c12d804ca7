"""Column forms of the language's commands: each maps a text (or an array of texts) to a Catalyst expression."""
