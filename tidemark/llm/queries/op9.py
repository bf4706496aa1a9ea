from ..common import table
from ..pii import KINDS, pseudonymize

KEY = "tidemark"
SQL = None


def query(spark, sf_dir):
    found = pseudonymize(table(spark, sf_dir, "documents"), key=KEY)
    return found.select("doc_id", "text", "n_private", *(f"n_{k}" for k in KINDS))
