"""Table schemas.  `project` is part of every key: nothing compares across it."""
from pyspark.sql import types as T

KEY = ["project", "file", "scope", "name"]

REGISTRY = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("value_preview", T.StringType()),
    T.StructField("value_hash", T.StringType()),
    T.StructField("redacted", T.BooleanType()),
    T.StructField("anno", T.StringType()),
    T.StructField("repo_value_preview", T.StringType()),
    T.StructField("repo_value_hash", T.StringType()),
    T.StructField("repo_line", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("first_session", T.StringType()),
    T.StructField("last_session", T.StringType()),
    T.StructField("first_seen_at", T.TimestampType()),
    T.StructField("last_written_at", T.TimestampType()),
    T.StructField("last_verified_at", T.TimestampType()),
    T.StructField("origin", T.StringType()),
    T.StructField("note", T.StringType()),
])
REGISTRY_COLUMNS = REGISTRY.fieldNames()

CORPUS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

EXTRACTED = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("scope", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("anno", T.StringType()),
])

REVIEWS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("pair_key", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

EVENTS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("detail", T.StringType()),
])

CHANGE_EVENTS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("tool_input", T.StructType([
        T.StructField("file_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("new_string", T.StringType()),
        T.StructField("edits", T.ArrayType(T.StructType([
            T.StructField("new_string", T.StringType())]))),
    ])),
    T.StructField("file_content", T.StringType()),
])
