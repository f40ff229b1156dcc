"""Training-data operators: each module holds one operator, its ``opN_*`` query and, where SQL can say it, its DuckDB SQL."""
