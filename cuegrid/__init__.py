"""cuegrid: timed-text analytics on Spark DataFrames.

Cues (subtitle rows), loudness frames, review marks and documents of many recordings are handled at once; ``rec_id`` is
the partitioning key and hot recordings are cut into time slabs.  See README.md.
"""
