"""Reading and writing listings: topics, payloads, pages, tables, files."""
