"""Network-security analytics on Spark: flows, DNS, alerts, labels, detectors, tuning and correlation as DataFrame operations."""
