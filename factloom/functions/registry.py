"""User functions: registered by name with the types they take and give, resolved after the built-in ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Registered:
    name: str
    function: Callable
    accepts: tuple[str, ...]
    yields: str
    total: bool


class Registry:
    """A name is registered once. Only total functions may be used in rules, since a rule has to have an answer."""

    def __init__(self):
        self._held: dict[str, Registered] = {}
        #: With overrides off, `pick` gives the plain plan, for parity tests.
        self.overrides = True

    def register(self, spark: SparkSession, name: str, function: Callable, accepts: tuple[str, ...], yields: str, *, total: bool = False):
        """A vectorised function (of pandas Series) as a column function; also for SQL under the same name."""
        if name in self._held:
            raise ValueError(f"{name} is registered already")
        udf = F.pandas_udf(function, yields)
        spark.udf.register(name, udf)
        self._held[name] = Registered(name, udf, accepts, yields, total)
        return udf

    def __getitem__(self, name: str) -> Registered:
        return self._held[name]

    def for_rules(self, name: str) -> Callable:
        if not self._held[name].total:
            raise ValueError(f"{name} isn't total and can't be used in a rule")
        return self._held[name].function

    def names(self) -> list[str]:
        return sorted(self._held)

    def unregistered(self, used: set[str]) -> set[str]:
        return used - set(self._held)

    def pick(self, fast: Callable, plain: Callable) -> Callable:
        return fast if self.overrides else plain
