"""Sources of files, vocabularies and options."""
