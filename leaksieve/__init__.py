"""Leak detection over tables and streams of text, as Spark DataFrame operators."""

from leaksieve.catalogue import default_rules
from leaksieve.operators.rules import RuleSet, load_rules, validate_rules
from leaksieve.options import MatchOptions, ScanOptions
from leaksieve.plans.scan import Scan, match_content, read_platform, scan, scan_platform
from leaksieve.session import build_session, configure, scratch_path
from leaksieve.sinks.reports import save_report
from leaksieve.sources.union import union_sources

__all__ = [
    "MatchOptions",
    "RuleSet",
    "Scan",
    "ScanOptions",
    "build_session",
    "configure",
    "default_rules",
    "load_rules",
    "match_content",
    "read_platform",
    "save_report",
    "scan",
    "scan_platform",
    "scratch_path",
    "union_sources",
    "validate_rules",
]
