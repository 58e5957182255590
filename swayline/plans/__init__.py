"""Named analyses: each composes operators into one result DataFrame."""
