"""Query op7_url_filters; trained trees have no SQL form."""

from emberframe.llm.common import Scratch, table
from emberframe.llm.urls import judge

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, Scratch(spark), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op7_url_filters": op7_url_filters}
ORACLES: dict = {}
