"""Sources and sinks (CSV, delimiter sniffing, tables, snapshots)."""

from .bounds import stored_bounds
from .readers import (foreign_files, header_lines, read_csv, read_delimited, read_first, read_parquet, read_table,
                      read_upload, sniff_delimiter, sniff_header)
from .sinks import (append_table, export_report, replace_table, report_lines, save_edits, snapshot, store_by_month,
                    write_csv)
from .versions import drop_old_versions, read_version

__all__ = ["foreign_files", "header_lines", "read_csv", "read_parquet", "read_delimited", "read_first", "read_table", "read_upload",
           "sniff_delimiter", "sniff_header", "append_table", "export_report", "replace_table", "report_lines",
           "save_edits", "snapshot", "stored_bounds", "store_by_month", "write_csv", "drop_old_versions", "read_version"]
