"""Query suites: each module has QUERIES and ORACLES."""
