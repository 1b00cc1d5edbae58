"""Independent DuckDB SQL for the registered queries, used to check their results."""
