"""Tables, files, searches and tool registries as DataFrames."""
