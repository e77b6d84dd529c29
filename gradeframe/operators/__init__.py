"""DataFrame operators.  Every function takes and returns DataFrames and
never triggers an action."""
