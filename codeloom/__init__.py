"""codeloom: code-corpus analytics and documentation quality as Spark jobs."""
