"""Topology of curve networks from 3-D point clouds, as Spark DataFrames."""

from .config import Config, NeighborConfig, ReduceConfig
from .operators.topology import SEGMENT_COLUMNS
from .plans.pipeline import Topology, extract, extract_topology, run_pipeline, trace
from .sources.clouds import as_cloud, dataset_schema, from_array, generate

__all__ = ["SEGMENT_COLUMNS", "Config", "NeighborConfig", "ReduceConfig", "Topology", "as_cloud", "dataset_schema", "extract", "extract_topology", "from_array", "generate", "run_pipeline", "trace"]
