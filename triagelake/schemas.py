"""Declared schemas of the engine's tables (no inference at read time)."""

from pyspark.sql import types as T

S = T.StringType()

INCIDENT = T.StructType([T.StructField(c, S) for c in
                         ["number", "short_description", "assignment_group",
                          "configuration_item", "resolution_notes"]])

KB_ARTICLE = T.StructType([T.StructField(c, S) for c in ["title", "body", "category"]])

CORPUS = T.StructType([T.StructField(c, S) for c in
                       ["id", "source", "training_text", "assignment_group",
                        "configuration_item", "category"]])

CORPUS_VEC = T.StructType(CORPUS.fields + [
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("norm", T.DoubleType())])

MANIFEST = T.StructType([
    T.StructField("model_name", S), T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("num_records", T.LongType()), T.StructField("date_created", T.TimestampType())])

REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("query", S),
    T.StructField("configuration_item", S), T.StructField("ticket_id", S),
    T.StructField("sys_id", S), T.StructField("top_k", T.IntegerType())])

HIT = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("id", S), T.StructField("similarity_score", T.DoubleType()),
    T.StructField("source", S), T.StructField("training_text", S),
    T.StructField("assignment_group", S), T.StructField("configuration_item", S),
    T.StructField("category", S)])

DECISION = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("automation_allowed", T.BooleanType()),
    T.StructField("approved_action", S), T.StructField("confidence", T.DoubleType()),
    T.StructField("reason", S), T.StructField("payload", S), T.StructField("llm_raw_output", S),
    T.StructField("llm_output", S)])
