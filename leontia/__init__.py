"""Multi-regional input-output analytics on Spark DataFrames."""

from leontia.model import DimensionError, LabeledMatrix, LabeledSeries
from leontia.plans.system import MRIO, EnvironmentalExtension, LeontiefSystem

__all__ = ["MRIO", "DimensionError", "EnvironmentalExtension", "LabeledMatrix", "LabeledSeries", "LeontiefSystem"]
