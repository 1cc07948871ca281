from evenkeel.sources.files import (
    load_table,
    read_column_json,
    read_delimited,
    read_experiment,
    write_report,
)

__all__ = ["load_table", "read_column_json", "read_delimited", "read_experiment", "write_report"]
