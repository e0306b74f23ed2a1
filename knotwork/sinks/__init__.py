"""Where graphs go: stored graphs, payloads and tables, notes and diagrams, reports."""
