"""Query plans: adapters from the given test tables to the canonical
shapes, and the registered query catalogue."""
