"""inkveil: de-identification and corpus-preparation operators for PySpark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function; Catalyst
picks the physical plan.  Sub-packages:

functions   column functions (detectors, checksums, hashing, similarity)
operators   DataFrame operators (entity masking, JSON rules, guardrails, reports)
sources     readers and writers (entity lists, rule files, corpora, vaults, metrics)
plans       composed jobs (profiles, redaction pipeline, accuracy report)
streaming   Structured Streaming forms
"""

__version__ = "0.1.0"
