"""Relational operators as functions from DataFrames to DataFrames; all are lazy and planned by Catalyst."""

from gridloom.operators.aggregation import aggregate, group_id, grouping_sets, mark_distinct, sorted_aggregate
from gridloom.operators.joins import anti_join, join, nested_loop_join, semi_filter, semi_project
from gridloom.operators.rows import assign_unique_id, enforce_single_row, expand, filter_rows, project, unnest
from gridloom.operators.sets import except_, intersect, union, union_all
from gridloom.operators.sorting import limit, merge_sorted, order_by, repartition, sort_partitions, top_n
from gridloom.operators.windows import ntile_by, row_number, shift_by, top_n_row_number, window

__all__ = [
    "aggregate", "anti_join", "assign_unique_id", "enforce_single_row", "except_", "expand", "filter_rows", "group_id", "grouping_sets", "intersect", "join", "limit", "mark_distinct",
    "merge_sorted", "nested_loop_join", "ntile_by", "order_by", "project", "repartition", "row_number", "semi_filter", "semi_project", "shift_by", "sort_partitions", "sorted_aggregate",
    "top_n", "top_n_row_number", "union", "union_all", "unnest", "window",
]
