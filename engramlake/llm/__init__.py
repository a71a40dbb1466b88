"""Training-data operators: the thirteen large-corpus components and their queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only when the folder is present.
"""
