"""See README: package layout."""
