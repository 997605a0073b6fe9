"""Plans: the lifecycle mart, reports, data-quality checks, profiling, sinks and views."""
