"""Compositions: the whole run, and the roles the benchmark tables play."""
