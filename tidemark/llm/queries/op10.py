from ..common import table
from ..near_dedup import near_duplicates

SQL = None


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
