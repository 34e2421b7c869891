"""weftmap: Spark-native analytics over sparse symmetric contact matrices and ordered segments."""
