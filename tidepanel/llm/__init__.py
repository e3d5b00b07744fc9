"""Training-data operators: scans, near-duplicates, classifiers, tokenisation and extraction on Spark.

Nothing else in the library imports this subpackage.
"""
