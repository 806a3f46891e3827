"""Roster reconciliation as Spark DataFrames.

Many messy tabular files are resolved against one roster: header repair,
column roles by alias and content, member lookup by id, name, swapped name or
merged name, value parsing and clamping, first claim per member in file order.
"""

from rollcall.operators.answers import replay
from rollcall.operators.decisions import Decisions
from rollcall.plans.from_files import observe_files, reconcile_files
from rollcall.plans.reconcile import Params, Reconciliation, reconcile

__all__ = [
    "Decisions",
    "Params",
    "Reconciliation",
    "observe_files",
    "reconcile",
    "reconcile_files",
    "replay",
]
