"""Credit-reporting analytics on Spark DataFrames: declarations, rules, identities, scorecard, reports."""
