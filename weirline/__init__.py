"""weirline: telemetry and log analytics as PySpark DataFrame transformations."""
