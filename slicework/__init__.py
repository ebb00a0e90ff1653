"""Table operators for medical-imaging data sets and model evaluation on PySpark."""
