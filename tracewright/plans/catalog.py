"""Imports every module that registers queries."""

from tracewright.plans import module_queries, relational_queries, retrieval_queries, source_queries, text_queries, trace_queries  # noqa: F401

FLAGSHIP = "task_success"
