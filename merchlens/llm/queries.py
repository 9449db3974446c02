"""Importing this module registers every query of the subpackage."""

import importlib

from merchlens.llm.registry import ORACLES, QUERIES

MODULES = (
    "chat", "decontam", "fim", "html", "langid", "licences", "linededup", "mixing", "packing", "quality", "repair", "sharding",
    "simhash",
)
for _module in MODULES:
    importlib.import_module(f"merchlens.llm.{_module}")

__all__ = ["ORACLES", "QUERIES"]
