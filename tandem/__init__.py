"""tandem: Spark-native analytics for coupled-generation evaluation of language models.

Every operator is a function from DataFrames to DataFrames. Sub-packages:

* ``functions`` -- column expressions (keyed uniforms, reply parsing, statistics);
* ``sources``   -- table loading, derived test fixtures, file scans and sinks;
* ``operators`` -- the evaluation operators (scoring, paired analysis, sub-sampling,
  pairwise win-rates, rank-sets, vocabularies, token sampling, prompts, run plans, densities);
* ``plans``     -- the registered queries and their DuckDB oracle SQL;
* ``streaming`` -- incremental (Structured Streaming) form of the pairwise counts.
"""

__version__ = "0.1.0"
