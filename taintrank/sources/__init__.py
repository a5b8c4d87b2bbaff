"""Sources and sinks (S1-S17) and the fixtures derived from the given tables."""
