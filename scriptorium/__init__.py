"""Table-in/table-out Spark operators for curating and searching text archives.

``functions``  column helpers and text matching
``sources``    readers and writers
``operators``  one module per operator family
``plans``      whole jobs composed from operators
``streaming``  incremental ingest of newly arriving posts
"""
