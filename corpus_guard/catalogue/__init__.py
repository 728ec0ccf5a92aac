"""The rule catalogues: two built-in rule sets and the declarative rules table."""

from corpus_guard.catalogue.model import Rule
from corpus_guard.catalogue.package_rules import package_rules
from corpus_guard.catalogue.standalone_rules import standalone_rules

__all__ = ["Rule", "package_rules", "standalone_rules"]
