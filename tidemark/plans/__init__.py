"""Registered queries; importing this package fills the registry."""

import importlib
import pkgutil

from .registry import REGISTRY

for _module in pkgutil.iter_modules(__path__):
    if _module.name.startswith("q_"):
        importlib.import_module(f"{__name__}.{_module.name}")

__all__ = ["REGISTRY"]
