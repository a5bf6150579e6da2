"""Part of the tidewatch engine."""
