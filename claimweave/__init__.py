"""claimweave: claim-graph analytics and document processing on Spark DataFrames."""

__version__ = "0.1.0"
