"""Reading and writing: files, workbooks and catalog tables."""
