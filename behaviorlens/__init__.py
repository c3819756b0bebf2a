"""PySpark-native behavioural analytics: activity logs to baselines, windows, graphs, alerts."""
