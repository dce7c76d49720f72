"""Survey tabulation on Spark: link, weight, tabulate, monitor and export interviews."""

__version__ = "0.1.0"
