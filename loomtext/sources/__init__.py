"""Reading corpora, printing in order, and writing rewritten documents back."""

from .corpus import commit, in_order, print_outputs, read_binary, read_input, read_lines, read_texts, stage, write_back, write_outputs, write_texts

__all__ = ["commit", "in_order", "print_outputs", "read_binary", "read_input", "read_lines", "read_texts", "stage", "write_back", "write_outputs", "write_texts"]
