"""Sources and sinks: derived test tables, export documents, raw explorer
pages, synthetic data, model store."""
