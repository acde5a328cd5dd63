"""Sources and sinks: driver tables, derived change-set fixtures, diff files."""
