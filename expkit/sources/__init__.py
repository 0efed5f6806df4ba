"""Table access: session settings, test-data adapters, sinks and coverage checks."""
