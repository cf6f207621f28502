"""Workloads made of operators, and the registered queries."""
