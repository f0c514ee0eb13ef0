"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

ENTITY = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("word", T.StringType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])
ENTITY_ARRAY = T.ArrayType(ENTITY)

RAW_STATEMENTS = T.StructType([
    T.StructField("statement", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

SWEEP_RESULT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("epochs", T.IntegerType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("best_f1", T.DoubleType()),
    T.StructField("final_epoch", T.DoubleType()),
    T.StructField("best_checkpoint", T.StringType()),
])

# A prediction export: the columns that analyses read, by name.
PREDICTION_EXPORT = T.StructType([
    T.StructField("statement", T.StringType()),
    T.StructField("label_binary", T.IntegerType()),
    T.StructField("A_raw_entities", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])
