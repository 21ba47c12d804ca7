"""From programs to DataFrames: built-in expressions where they are exact, else row-local Arrow batches."""
