from quillrank.sources.tables import materialize, read_table, spread
from quillrank.sources.csvs import read_csv, write_csv
from quillrank.sources.records import document_records, html_records, RECORD_COLUMNS

__all__ = ["materialize", "read_table", "spread", "read_csv", "write_csv", "document_records", "html_records", "RECORD_COLUMNS"]
