"""The record language: fields, variables, associative arrays, formatted output."""
