"""matchlog: feature queries over two-player match action logs, written for Spark."""
