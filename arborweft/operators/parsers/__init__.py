"""Error-tolerant structural readers of source languages, in plain Python: they see declarations, scopes and calls."""
