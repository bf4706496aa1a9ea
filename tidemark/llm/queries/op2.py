from ..common import table
from ..quote_links import link_quotes, reply_ordered

SQL = None


def query(spark, sf_dir):
    return reply_ordered(link_quotes(table(spark, sf_dir, "conversations")))
