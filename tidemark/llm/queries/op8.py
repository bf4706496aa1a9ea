from ..common import table
from ..html_text import extract_pages

SQL = None


def query(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
