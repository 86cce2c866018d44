"""Operators for preparing large text corpora.

Nothing outside this package imports it.  Every operator keeps whole texts and
whole tables, bounds what one task holds, and cuts lineage only through the
folder that the session names in ``spark.checkpoint.dir``.
"""
