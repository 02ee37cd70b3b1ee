from tessera.operators.relational import duplicate_removal, group_by, join, project, select_file, select_pipe, sort, sort_all, sum_, write_out

__all__ = ["duplicate_removal", "group_by", "join", "project", "select_file", "select_pipe", "sort", "sort_all", "sum_", "write_out"]
