"""Operators for preparing language-model training data (self-contained: nothing else imports this)."""
