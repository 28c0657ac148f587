"""DataFrame operators: tables, intervals, trials, scoring, metrics, clustering."""
