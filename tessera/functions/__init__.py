"""Pure functions over one source file: lexers, parsers and fact extractors.  No Spark here."""
