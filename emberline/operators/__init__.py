"""Part of the thermal-event engine."""
