"""Sources and sinks: series tables, measurement facts, corpora and models."""
