"""Event analytics for delivery and e-commerce streams, as Spark jobs.

``schemas``    table layouts, keys and closed value sets
``functions``  column expressions
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers, loaders, publishing, exports, inventory
``streaming``  Structured Streaming ingest, replay and windows
``plans``      complete reports composed from the operators
``registry``   the reports and operators bound to the driver tables
"""
