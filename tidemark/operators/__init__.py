"""Operators over DataFrames: checks, profiles, keys, recovery, treatment, star schema, ordering."""
