"""Audits of labelled datasets and classifiers, as DataFrame and SQL plans on Spark."""
