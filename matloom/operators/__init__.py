"""Matrix and graph operators over DataFrames."""
