from . import catalogue, filter_queries, fusion_queries, workflow_queries

__all__ = ["catalogue", "filter_queries", "fusion_queries", "workflow_queries"]
