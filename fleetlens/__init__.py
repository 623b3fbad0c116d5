"""Set-based Spark operators over the metadata of many data projects at once."""
