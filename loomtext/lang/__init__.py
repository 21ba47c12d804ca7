"""The structural language: patterns, programs, records."""
