import textwrap
from pathlib import Path

import pandas as pd
from plumbline.llm import licenses

from tests.llm.held import DATA, odd_docs, same_as_sql


def test_table(spark):
    same_as_sql(licenses.op6_licenses(spark, DATA), licenses.SQL, {"documents": f"{DATA}/documents.parquet"})
    found = {r.notices for r in licenses.op6_licenses(spark, "/root/testdata/sf0.01").collect()}
    assert {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"} <= found


def test_odd_rows(spark):
    docs = odd_docs(spark)
    frame = pd.DataFrame([r.asDict() for r in docs.collect()])
    same_as_sql(licenses.scanned(docs), licenses.SQL, {"documents": frame})
    assert licenses.scanned(docs.where("false")).count() == 0


def text_of(name):
    return (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text()


def test_spellings(spark):
    mit = text_of("MIT").split("\n\n", 2)[2]
    all_ = "the mit licence (MIT)\nCopyright © 2020 Somebody\n(c) 2021 Another\n\n" + mit.replace('"', "“").upper()
    rows = [(1, all_), (2, "x\n  ** Licenced under CC BY-NC 4.0 **\nReleased under the M.I.T. licence"), (3, "copyright 1999\n...\n"), (4, mit + " more"), (None, "LICENCED UNDER THE APACHE LICENCE -- VERSION 2.0"), (1, all_), (5, "house rules apply."), (6, "Copyright 2020 X. Licensed under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([("House", "House Rules: apply!"), ("Empty", "(c) 2020 me")], "license string, text string")
    got = sorted((r.doc_id or 0, r.license, r.notices) for r in licenses.scanned(docs, more).collect())
    # in 4 the first two paragraphs are whole ones of the licence, but no known text by themselves
    assert got == [(0, "Apache-2.0", "Apache-2.0"), (1, "MIT", ""), (1, "MIT", ""), (2, None, "CC-BY-NC-4.0"), (3, None, ""), (4, None, ""), (5, "House", "House"), (6, "MIT", "MIT")]


def test_full_texts_in_other_layouts(spark):
    """Every known text, wrapped anew, in capitals, with another holder; and each header between other paragraphs."""
    rows, want = [], {}
    for i, path in enumerate(sorted((Path(licenses.__file__).parent / "license_texts").iterdir())):
        name, _, kind = path.stem.partition(" ")
        text = path.read_text().replace("<year> <copyright holders>", "2019-2021 Ann & Co").replace("<year> <owner>", "2020 Bob")
        blocks = text.split("\n\n")
        wrapped = "\n\n".join(b if "opyright (" in b or "(C)" in b else textwrap.fill(b, 60 + i, break_on_hyphens=False) for b in blocks)
        rows += [(i, text), (100 + i, wrapped.replace("license", "licence")), (200 + i, text.upper())]
        want |= {100 * k + i: name for k in range(3)}
        if kind:
            rows.append((300 + i, "Some program.\n\n" + "\n".join("# " + x for x in text.strip().split("\n")) + "\n\nimport this\n"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert {k: got[k].license for k in want if got[k].license != want[k]} == {}
    assert all(name in got[300 + i].notices.split(",") for i, name in want.items() if 300 + i in got)
    same_as_sql(licenses.scanned(docs), licenses.SQL, {"documents": pd.DataFrame(rows, columns=["doc_id", "text"])})


def test_nothing_but_the_few_found_is_shuffled(spark):
    docs = odd_docs(spark)
    plan = licenses.scanned(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [digest" in plan
