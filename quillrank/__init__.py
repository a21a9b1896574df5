"""quillrank: page-quality analytics on Spark DataFrames.

Pages (captured HTML or plain documents) become PageRecords, then per-page
text and structure features, labels, bucketed model inputs, quality scores and
reports. Everything is expressed as DataFrame / SQL plans so Catalyst can prune,
push down and fuse the work; Python runs only where Spark ML or a small
per-batch helper needs it.
"""

__version__ = "0.1.0"
