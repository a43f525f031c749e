"""An ordered key-value analytics engine on DataFrames: a log of mutations, folded."""
