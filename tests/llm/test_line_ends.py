"""White space after a sentence does not make its line fail."""

import os

import pytest
from compare import database, same

from epochal.llm import linerules, registry

SF_DIR = "/root/testdata/sf0.001"


def test_line_ends_keep_clean_documents(spark):
    line = lambda k: " ".join(f"word{k}{n}" for n in range(9))
    ends = ["\n", "\r\n", "\t\n", " \n", "   \n", "\x0b\x0c\n"]
    rows = [(i, "".join(line(k) + "." + end for k in range(4))) for i, end in enumerate(ends)]
    rows.append((9, "".join(line(k) + "\r\n" for k in range(4))))
    got = {r.doc_id: (r.kept, r.n_removed_lines) for r in linerules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (True, 0) for i in range(len(ends))} | {9: (False, 4)}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_given_documents_stay_as_in_sql(spark):
    same(registry.queries()["op6_line_rules"](spark, SF_DIR), database(SF_DIR), linerules.sql())
