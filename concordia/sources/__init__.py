"""Sources and sinks: driver tables, derived fixture relations, text/JSON/CSV/log scans."""
