from rollcall.sources.tables import SCHEMAS, read_table

__all__ = ["SCHEMAS", "read_table"]
