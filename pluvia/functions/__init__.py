"""Column builders: pure expressions that Catalyst folds into the scan stage."""
