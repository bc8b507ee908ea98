"""Compositions of operators: the nightly refresh and the registered queries."""
