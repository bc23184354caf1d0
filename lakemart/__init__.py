"""Loading and keeping history in layered analytic tables, on Spark."""
