"""The live inventory under a view name, for SQL text written for it elsewhere."""

from pyspark.sql import DataFrame, SparkSession

# SQL functions are expanded by the optimiser, so they cost what their bodies cost. An
# object or array has no scalar; text is one if it parses as one. The built-in probe gives
# the word null for a null within an array.
_FUNCTIONS = (
    """
    CREATE OR REPLACE TEMPORARY FUNCTION json_extract(doc STRING, path STRING)
    RETURNS STRING RETURN get_json_object(doc, path)
    """,
    """
    CREATE OR REPLACE TEMPORARY FUNCTION json_extract_scalar(doc STRING, path STRING)
    RETURNS STRING RETURN CASE
      WHEN left(get_json_object(doc, path), 1) IN ('{', '[')
       AND (json_array_length(get_json_object(doc, path)) IS NOT NULL
         OR json_object_keys(get_json_object(doc, path)) IS NOT NULL) THEN NULL
      WHEN path LIKE '%]' AND get_json_object(doc, path) = 'null' THEN NULL
      ELSE get_json_object(doc, path) END
    """,
)


# The view's name is a fixed value: texts written for it use that name.
def register_live(spark: SparkSession, live: DataFrame, name: str = "operational_live") -> None:
    """Make live rows a temporary view, and define the JSON functions such SQL uses."""
    live.createOrReplaceTempView(name)
    for statement in _FUNCTIONS:
        spark.sql(statement)
