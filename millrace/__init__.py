"""Real-time warehouse operators for e-commerce logs, change events and orders.

Every operator is a ``DataFrame -> DataFrame`` function that serves batch
queries and Structured Streaming alike.  Sinks and live dimension reads sit in
``foreachBatch`` wrappers under :mod:`millrace.streaming`.
"""
