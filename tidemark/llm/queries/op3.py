from ..common import table
from ..suffix_dedup import repeated_passages

SQL = None


def query(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
