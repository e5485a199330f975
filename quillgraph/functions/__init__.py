"""Column functions: page names, wiki text, dates and enum codes."""
