"""DataFrame operators: each takes and returns DataFrames and says what it shuffles."""
