"""One function per operator, each DataFrame -> DataFrame."""
