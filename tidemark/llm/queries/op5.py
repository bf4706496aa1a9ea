from pyspark.sql import functions as F

from ..common import table
from ..quality_classifier import classify

SQL = None


def site():
    """Host and path of ``documents``: its source, and the language within it."""
    return {"host": F.col("source"), "path": F.col("lang")}


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **site())
