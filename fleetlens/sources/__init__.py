"""Sources and sinks: raw logs, CSV inputs, tuned configs, snapshots."""
