"""trailmark: behavioural event modelling and enrichment on Spark DataFrames."""

from trailmark.config import ModelConfig

__all__ = ["ModelConfig"]
