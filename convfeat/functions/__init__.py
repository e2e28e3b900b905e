"""Row-wise expressions as Spark SQL text, shared by batch and streaming jobs.

Every function takes and returns SQL text; a column name is the simplest argument. Lambdas
then nest freely and a wide projection reaches the JVM as a few strings to parse, instead of
thousands of calls. Use the result with ``F.expr`` or ``selectExpr``. Only ``scoring``, a few
scalar losses, works on columns.
"""
