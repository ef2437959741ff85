"""panelwright: point-in-time analytics over (entity, date) panels on Spark."""

__version__ = "0.1.0"
