"""Where tables come from and go: source files and keyed Parquet tables."""
