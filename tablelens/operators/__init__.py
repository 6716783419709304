"""Profiling, type inference, typed clones, DDL and exports."""
