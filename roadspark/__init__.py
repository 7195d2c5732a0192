"""Road-network, signal and fleet-telemetry jobs on Spark."""
