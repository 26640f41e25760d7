"""Data discovery and readiness checks for machine learning, on Spark DataFrames."""

from plumbline.operators.datasets import profile, profile_sources
from plumbline.plans.discover import analyse_features, discover
from plumbline.sources.readers import load
from plumbline.sources.samples import load_sample

__all__ = ["analyse_features", "discover", "load", "load_sample", "profile", "profile_sources"]
