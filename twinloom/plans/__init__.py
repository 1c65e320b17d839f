"""The query language: text to syntax tree to lazy DataFrame plan."""

from twinloom.plans.compile import Bound, ExecutionError, bind, check_rows, measure
from twinloom.plans.language import Check, Match, ParseError, parse, parse_check, parse_temporal

__all__ = ["Bound", "Check", "ExecutionError", "Match", "ParseError", "bind", "check_rows", "measure", "parse", "parse_check", "parse_temporal"]
