"""Code graph and hybrid retrieval as Spark jobs: tables in, tables out."""
