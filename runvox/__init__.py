"""Volume cohort analytics as Spark DataFrames: run-length voxel tables in, audit tables out."""
