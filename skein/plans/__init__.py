"""The guarded SQL tool and the catalogue of queries."""
