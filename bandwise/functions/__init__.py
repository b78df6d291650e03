"""Row-level expressions: arithmetic, math, row-wise summaries, predicates, labels."""
