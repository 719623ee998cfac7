"""Evidence-grounded analytics over event logs and transcripts, as PySpark DataFrame operators."""
