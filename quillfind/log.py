"""Levelled log with a component in each line."""

from __future__ import annotations

import sys

LEVELS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}


class Logger:
    """Lines at or above a level go out as '[LEVEL] [component] message'; a level above ERROR silences all."""

    def __init__(self, level: str | int = "INFO", out=None) -> None:
        self.set_level(level)
        self.out = out or (lambda line: print(line, file=sys.stderr))

    def set_level(self, level: str | int) -> None:
        self.level = LEVELS[level] if isinstance(level, str) else level

    def enabled(self, level: str) -> bool:
        return LEVELS[level] >= self.level

    def log(self, level: str, component: str, message: str, *more) -> None:
        if self.enabled(level):
            self.out(" ".join([f"[{level}] [{component}] {message}", *map(str, more)]))

    def debug(self, component: str, message: str, *more) -> None:
        self.log("DEBUG", component, message, *more)

    def info(self, component: str, message: str, *more) -> None:
        self.log("INFO", component, message, *more)

    def warn(self, component: str, message: str, *more) -> None:
        self.log("WARN", component, message, *more)

    def error(self, component: str, message: str, *more) -> None:
        self.log("ERROR", component, message, *more)


logger = Logger()
