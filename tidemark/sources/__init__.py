from tidemark.sources.binding import (ROLE_ALIASES, RoleBinding, SchemaError, bind_roles,
                                      canonical_frame, drop_unusable, normalise_headers,
                                      rejected_rows)
from tidemark.sources.csv_source import prepare, read_transactions_csv
from tidemark.sources.tables import (raw_transactions, read_table, sales_fact)

__all__ = ["ROLE_ALIASES", "RoleBinding", "SchemaError", "bind_roles", "canonical_frame",
           "drop_unusable", "normalise_headers", "rejected_rows", "prepare",
           "read_transactions_csv", "raw_transactions", "read_table", "sales_fact"]
