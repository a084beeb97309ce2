"""Grants and blocked addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import address, cidr_range


def granted(links: DataFrame, grants: DataFrame, user: str, resource: str, any_user: str = "*") -> DataFrame:
    """Links whose resource is granted to the user or to any user; with no grants declared for anyone, all links."""
    own = grants.where(F.col("user").isin(user, any_user)).select(F.col(resource).alias("_g")).distinct()
    if grants.isEmpty():
        return links
    return links.join(own, F.col(resource) == F.col("_g"), "left_semi")


def blocked(urls: DataFrame, column: str, blocks: list[str]) -> DataFrame:
    """Rows whose url's host is an address in one of the CIDR blocks."""
    host = address(F.regexp_extract(column, r"^[a-z]+://(?:[^@/]*@)?([^:/?#]+)", 1))
    hit = F.lit(False)
    for low, high in map(cidr_range, blocks):
        hit = hit | host.between(low, high)
    return urls.where(F.coalesce(hit, F.lit(False)))
