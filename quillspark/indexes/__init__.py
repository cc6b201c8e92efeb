"""Search indexes as tables: vectors by nearest centroid, terms by posting lists."""
