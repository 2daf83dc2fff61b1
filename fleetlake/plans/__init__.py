"""Bindings of the operators to the test tables, each with an independent SQL twin."""
