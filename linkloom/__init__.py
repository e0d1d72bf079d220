"""linkloom: schema-agnostic entity resolution on Spark DataFrames."""

from linkloom.plans.paths import InputPaths, resolve_paths
from linkloom.plans.resolver import Resolver, ResolverConfig

__all__ = ["InputPaths", "Resolver", "ResolverConfig", "resolve_paths"]
