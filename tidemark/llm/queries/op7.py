from ..common import table
from ..mixing import mix_by_source

SEED = 7


def query(spark, sf_dir):
    mixed = mix_by_source(table(spark, sf_dir, "documents"), seed=SEED)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The flow over shared texts is not a SQL function.
SQL = None
