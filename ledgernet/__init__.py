"""Spending-graph analytics expressed as Spark DataFrame plans."""

from ledgernet.graph import SpendGraph
from ledgernet.plans.load import load_graph
from ledgernet.plans.report import analyze_graph
from ledgernet.plans.suite import run_suite

__all__ = ["SpendGraph", "analyze_graph", "load_graph", "run_suite"]
