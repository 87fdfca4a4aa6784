"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
