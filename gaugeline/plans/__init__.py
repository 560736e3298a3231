"""Registered queries by area; ``load`` imports every module that registers some."""

import importlib
import pkgutil


def load() -> None:
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
