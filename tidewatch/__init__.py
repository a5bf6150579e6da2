"""tidewatch: what changed in daily series since a reader last looked, on Spark."""
